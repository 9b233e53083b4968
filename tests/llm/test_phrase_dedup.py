import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sparkprep.llm import lm_scoring, phrase_dedup, suffix_dedup


def words(text):
    text = text or ""
    for c in "\t\n\v\f\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def order(i):
    return float("inf") if i is None else i


def plain(rows, window):
    first = {}
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            first[key] = min(order(i), first.get(key, float("inf")))
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < order(i):
                gone.update(range(p, p + window))
        kept = " ".join(x for at, x in enumerate(w) if at not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def shown(found):
    return sorted(
        (
            (
                r.doc_id,
                r.n_words,
                sum(s.end - s.start for s in r.removed),
                hashlib.sha256(r.kept_text.encode()).hexdigest(),
            )
            for r in found.collect()
        ),
        key=str,
    )


@pytest.mark.parametrize("window, phrase", [(6, 2), (5, 5), (50, 8)])
def test_against_plain_version(docs, odd, texts, window, phrase):
    draw = random.Random(window)
    rows = odd + [(100 + i, t) for i, t in texts[:60]]
    for i in range(40):
        parts = [words(t) for _, t in draw.sample(texts[:60], 2)]
        cut = [draw.randint(0, len(p)) for p in parts]
        rows.append((draw.randint(-50, 400), " ".join(parts[0][: cut[0]] + parts[1][cut[1] :])))
    rows += [(500 + i, " ".join(draw.choices("ab", k=80))) for i in range(20)]
    found = phrase_dedup.remove_repeats(docs(rows), window, phrase)
    assert shown(found) == plain(rows, window)


def test_supplied_table(docs, texts):
    assert shown(phrase_dedup.remove_repeats(docs(texts))) == plain(texts, 50)


def test_empty_table(docs):
    assert phrase_dedup.remove_repeats(docs([])).collect() == []


def test_largest_and_smallest_ids_and_none(spark, docs):
    """Three operators over blocks: no id comes back as another, or as none."""
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(2**63 - 1, passage), (-(2**63), "a b c"), (None, "d e f"), (None, passage), (0, passage)]
    ids = sorted((r[0] is None, r[0] or 0) for r in rows)
    found = {
        "words": phrase_dedup.remove_repeats(docs(rows)),
        "bytes": suffix_dedup.remove_repeats(docs(rows)),
        "score": lm_scoring.score(docs(rows), F.col("doc_id") == 0),
    }
    for frame in found.values():
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in frame.collect()) == ids
    kept = {(r.doc_id, r.kept_text) for r in found["words"].collect()}
    assert kept == {(2**63 - 1, ""), (-(2**63), "a b c"), (None, "d e f"), (None, ""), (0, passage)}
