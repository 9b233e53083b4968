from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkprep.llm import language_id

SCHEMA = "doc_id bigint, text string, lang string, score double, rank int"


def grams(text):
    out = Counter()
    word = ""
    for c in (text or "").lower() + " ":
        if c.isalpha():
            word += c
            continue
        if word:
            out.update(word)
            padded = f" {word} "
            for n in (2, 3):
                out.update(padded[i : i + n] for i in range(len(padded) - n + 1))
        word = ""
    return out


def code(gram):
    value = 0
    for c in gram:
        value = value << 21 | ord(c)
    return value


def profile(counts, size):
    return sorted(counts, key=lambda g: (-counts[g], code(g)))[:size]


def plain(rows, size):
    sums = {}
    for i, t, lang in rows:
        if i is not None and i % 5 and t is not None and lang is not None:
            sums.setdefault(lang, Counter()).update(grams(t))
    known = {lang: {g: r for r, g in enumerate(profile(c, size))} for lang, c in sums.items()}
    out = []
    for i, t, _ in rows:
        mine = profile(grams(t), size)
        if not mine or not known:
            out.append((i, "und", 0.0))
            continue
        far = {
            lang: sum(abs(r - ranks[g]) if g in ranks else size for r, g in enumerate(mine))
            for lang, ranks in known.items()
        }
        best = min(sorted(known, key=str.encode), key=far.get)
        out.append((i, best, 1 - far[best] / (size * len(mine))))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [10, 300])
def test_against_plain_version(spark, odd, texts, size):
    langs = dict(
        spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang").collect()
    )
    rows = [(i, t, "xx" if i == 4 else None) for i, t in odd]
    rows += [(100 + i, t, langs[i]) for i, t in texts]
    rows += [(900, "123 456 %%%", "en"), (901, "İstanbul ǅ ﬁ", None), (902, "'", None)]
    frame = spark.createDataFrame([(*r, 0.5, 1) for r in rows], SCHEMA).repartition(4)
    found = language_id.identify(frame, F.col("doc_id") % 5 != 0, size=size).collect()
    got = sorted(((r.doc_id, r.lang_pred, r.score) for r in found), key=str)
    wanted = plain(rows, size)
    assert [g[:2] for g in got] == [w[:2] for w in wanted]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in wanted])
    held = [r for r in found if r.doc_id and 100 <= r.doc_id < 400 and not r.learned]
    if size == 300:
        right = sum(r.lang_pred == langs[r.doc_id - 100] for r in held)
        assert right >= 0.95 * len(held) > 20


def test_empty_table_and_nothing_to_learn(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert language_id.identify(empty, F.lit(True)).collect() == []
    rows = spark.createDataFrame([(1, "some text", None, 0.1, 2)], SCHEMA)
    (row,) = language_id.identify(rows, F.lit(True)).collect()
    assert (row.lang_pred, row.score) == ("und", 0.0)


def test_text_of_a_gram():
    assert [language_id.gram_text(code(g)) for g in ("a", " a", "日本語")] == ["a", " a", "日本語"]
