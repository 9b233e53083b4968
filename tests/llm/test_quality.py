import math
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkprep.llm import blocks, grams, quality

SCHEMA = "doc_id bigint, text string, lang string, good bigint, own double, threshold double"


def tokens(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return ["<s>", *lowered.replace("\n", " ").split(" "), "</s>"]


def clean(text):
    return [t for t in tokens(text) if t]


class Plain:
    """Interpolated modified Kneser-Ney by dictionaries."""

    def __init__(self, texts, order):
        self.order = order
        raw = [Counter() for _ in range(order + 1)]
        for text in texts:
            w = clean(text)
            for k in range(1, order + 1):
                for i in range(len(w) - k + 1):
                    if i + k > 1:
                        raw[k][tuple(w[i : i + k])] += 1
        self.a = [Counter() for _ in range(order + 1)]
        for k in range(1, order + 1):
            before = Counter(g[1:] for g in raw[k + 1]) if k < order else None
            for g, n in raw[k].items():
                begins = g[0] == "<s>"
                self.a[k][g] = n if k == order or begins else before.get(g, n)
        self.d, self.total, self.left = [None], {}, {}
        for k in range(1, order + 1):
            t = [sum(v == c for v in self.a[k].values()) for c in range(5)]
            y = t[1] / (t[1] + 2 * t[2]) if t[1] else 0.5
            d = [c - (c + 1) * y * t[c + 1] / t[c] if t[c] else c / 2 for c in (1, 2, 3)]
            self.d.append([min(max(x, 0.05), c - 0.05) for c, x in zip((1, 2, 3), d, strict=True)])
            for g, v in self.a[k].items():
                h = k, g[:-1]
                self.total[h] = self.total.get(h, 0) + v
                self.left[h] = self.left.get(h, 0) + self.d[k][min(v, 3) - 1]
        self.words = len(self.a[1])

    def chance(self, history, word):
        k = len(history) + 1
        shorter = 1 / (self.words + 1) if k == 1 else self.chance(history[1:], word)
        total = self.total.get((k, history))
        if not total:
            return 1.0 if k == 1 else shorter
        v = self.a[k].get((*history, word), 0)
        taken = self.d[k][min(v, 3) - 1] if v else 0
        return (v - taken) / total + self.left[k, history] / total * shorter

    def score(self, text):
        w = clean(text)
        return sum(
            math.log10(self.chance(tuple(w[max(0, i - self.order + 1) : i]), w[i]))
            for i in range(1, len(w))
        )


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_against_plain_model(docs, odd, texts, order):
    learned = [t for _, t in texts[:12]] + ["a b a b a c", "a b"]
    plain = Plain(learned, order)
    frame = docs(list(enumerate(learned))).select("text")
    rows = quality.shards(quality.model(frame, order))
    wanted = [t for _, t in odd if t is None or "\t" not in t] + [t for _, t in texts[5:20]]
    n, found = quality.Model(rows, order).score(wanted)
    assert n.tolist() == [len(clean(t)) - 1 for t in wanted]
    assert found.tolist() == pytest.approx([plain.score(t) for t in wanted], rel=1e-5, abs=1e-5)


def test_probabilities_add_up(texts):
    plain = Plain([t for _, t in texts[:6]], 3)
    words = [g[0] for g in plain.a[1]]
    for history in ((), (words[3],), ("<s>",), tuple(clean(texts[0][1])[3:5])):
        total = sum(plain.chance(history, w) for w in [*words, "never seen"])
        assert total == pytest.approx(1)


def test_odd_rows_and_no_trusted_text(spark, odd):
    frame = spark.createDataFrame([(*r, None, 1, 0.0, 0.0) for r in odd], SCHEMA)
    none = spark.createDataFrame([], "good bigint")
    found = quality.classify(frame, none).collect()
    assert len(found) == len(odd) and all(r.kept and r.threshold is None for r in found)
    assert quality.classify(frame.limit(0), none).collect() == []
    some = spark.createDataFrame([(i,) for i, _ in odd], "good bigint")
    found = quality.classify(frame, some).collect()
    assert len(found) == len(odd) and all(r.perplexity > 0 for r in found)


def test_sample_is_bounded_and_shared(spark):
    rows = [(i, "ab"[i % 7 == 0], 100) for i in range(400)]
    frame = spark.createDataFrame(rows, "id bigint, lang string, size int")
    ids = [r.chosen for r in quality.sample(frame, 2000).collect()]
    assert Counter("ab"[i % 7 == 0] for i in ids) == {"a": 10, "b": 10}


def taken(spark, rows, most):
    frame = spark.createDataFrame(rows, "id bigint, lang string, size int")
    found = quality.sample(frame, most).collect()
    assert sum(r["take"] for r in found) <= most and all(0 < r["take"] <= r["size"] for r in found)
    by_lang = Counter()
    for r in found:
        by_lang[r.lang] += r["take"]
    return by_lang


def test_room_that_languages_leave_is_passed_on(spark):
    rows = [(i, "main", 100) for i in range(4000)]
    rows += [(4000 + i, f"stray {i}", 10) for i in range(300)] + [(5000, None, 10)]
    found = taken(spark, rows, 20_000)
    small = sum(n for lang, n in found.items() if lang != "main")
    # Small languages teach all they have, the large one all the rest of the bound.
    learnable = len(found) - 1
    assert learnable > 150 and small == 10 * learnable
    assert found["main"] + small == 20_000


def test_a_large_language_among_many(spark):
    rows = [(i, "main", 100) for i in range(4000)]
    rows += [(4000 + i, f"other {i % 100}", 100) for i in range(8000)]
    found = taken(spark, rows, 100_000)
    assert found["main"] > 5000 and min(found.values()) >= 400 and len(found) == 101


def test_texts_longer_than_the_share_are_learned_from(spark):
    found = taken(spark, [(i, "ab"[i % 2], 5000) for i in range(20)], 2000)
    assert found == {"a": 1000, "b": 1000}


def test_rows_of_one_id_stay_in_the_bound(spark):
    ids = [i for i in range(10) if zlib.crc32(str(i).encode()) % quality.HELD_BACK]
    rows = [(ids[0], "a", 50)] * 100 + [(ids[1], "a", 50)]
    assert taken(spark, rows, 1000)["a"] == 1000
    assert taken(spark, rows, 10_000)["a"] == 5050


def test_a_text_learned_in_part():
    texts = ["One two three", "one two three", "one two", "onetwothree", " one", None]
    parts = quality.Tokens(texts, 2, [8, 7, 7, 5, 4, 0])
    assert parts.sizes.tolist() == [3, 3, 4, 1, 3, 2]
    whole = quality.Tokens(["one two"], 2)
    assert parts.runs[1][1:3].tolist() == whole.runs[1][1:3].tolist()
    assert quality.Tokens(["onetwothree"], 1, [5]).rows().empty


def test_clean_documents_of_the_supplied_table_are_kept(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = quality.classify(docs, labels.where("quality = 1").select("doc_id"))
    counts = found.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    kept = {r.quality: r.kept for r in counts.collect()}
    assert kept[1] > 0.95 and kept[0] < 0.5


@pytest.mark.parametrize("order", [1, 2, 3])
def test_all_trusted_text_is_learned_from(spark, odd, texts, order):
    rows = odd + [(20 + i, t) for i, t in texts[:60]]
    trusted = [i for i in range(80) if i % 3]
    frame = spark.createDataFrame(
        [(i, t, "ab"[n % 2] if n % 5 else None, 1, 0.0, 0.0) for n, (i, t) in enumerate(rows)], SCHEMA
    ).repartition(3)
    ids = spark.createDataFrame([(i,) for i in [*trusted, *trusted, None]], "good bigint")
    found = quality.classify(frame, ids, order=order).collect()
    learned = [
        t for i, t in rows if t and i in trusted and zlib.crc32(str(i).encode()) % quality.HELD_BACK
    ]
    plain = Plain([t.replace("\t", " ") for t in learned], order)
    wanted = []
    for n, (i, t) in enumerate(rows):
        t = t.replace("\t", " ") if t else t
        lang = "ab"[n % 2] if n % 5 else None
        wanted.append((i, lang, i in trusted, len(clean(t)) - 1, plain.score(t)))
    wanted.sort(key=str)
    got = sorted((tuple(r)[:5] for r in found), key=str)
    assert [r[:4] for r in got] == [r[:4] for r in wanted]
    for a, b in zip(got, wanted, strict=True):
        assert a[4] == pytest.approx(b[4])


def test_no_trusted_text_is_left_out_for_its_size(spark):
    rows = [(i, f"word{i} " * 80_000, "a", 1, 0.0, 0.0) for i in range(40)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = quality.classify(frame, frame.select("doc_id")).collect()
    learned = [r for r in found if zlib.crc32(str(r.doc_id).encode()) % quality.HELD_BACK]
    assert sum(len(rows[r.doc_id][1]) for r in learned) > 12 * 1024**2
    # A text that was learned from surprises by its first words only.
    assert all(r.perplexity < 1.01 for r in learned)
    assert all(r.perplexity > 1.01 for r in found if r not in learned)


def shuffled_bytes(spark):
    files = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().iterator()
    total = 0
    while files.hasNext():
        total += files.next().length()
    return total


def test_parts_of_the_keys_give_the_same_and_leave_no_shuffle_files(spark, texts, monkeypatch):
    rows = [(i, t, "ab"[i % 2], 1, 0.0, 0.0) for i, t in texts[:60]]
    rows += [(100 + i, f"one{i % 7}  two{i} " * 5000, "a", 1, 0.0, 0.0) for i in range(40)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    ids = frame.select("doc_id").where("doc_id % 3 > 0")
    # Several blocks, so several ranges, in parts that are not equal.
    monkeypatch.setattr(quality, "_BLOCK_BYTES", 400_000)
    before = shuffled_bytes(spark)
    found = quality.classify(frame, ids)
    deadline = time.monotonic() + 10
    while (left := shuffled_bytes(spark) - before) > 200_000 and time.monotonic() < deadline:
        time.sleep(0.2)
    assert left < 200_000
    learned = [r[1] for r in rows if r[0] % 3 and zlib.crc32(str(r[0]).encode()) % quality.HELD_BACK]
    plain = Plain([" ".join(t.split()) for t in learned if t], 3)
    wanted = {r[0]: plain.score(" ".join((r[1] or "").split())) for r in rows}
    got = {r.doc_id: r.log10_prob for r in found.collect()}
    assert got == pytest.approx(wanted)


@pytest.mark.parametrize("ranges", [1, 2, 3, 7, 1000])
@pytest.mark.parametrize("level", [0, 1, 2])
def test_parts_are_whole_ranges_and_all_keys(ranges, level):
    parts = quality._parts(ranges, level, 3)
    assert [a for a, _ in parts[1:]] == [b for _, b in parts[:-1]]
    assert parts[0][0] == 0 and parts[-1][1] == 1 << 64
    assert all(a in {(r << 64) // ranges for r in range(ranges)} for a, _ in parts)


def test_blocks_hold_the_words_of_their_texts(odd):
    many = [(t or "").encode() for _, t in odd] + [b"", b" ", b"  A\x0bB\x1cc\x85\xc3\x89\n", b"\xed\xa0\x80 q"]
    for some in (many, many[:1], [b""], []):
        tokens, sizes, words = grams.unpack_words(grams.pack_words(some), b" >", b" <")
        wanted, lengths, names = grams.numbered(some, b" >", b" <")
        assert sizes.tolist() == lengths.tolist()
        assert [words[i] for i in tokens.tolist()] == [names[i] for i in wanted.tolist()]
    once = b" ".join(b"word%d" % (i % 500) for i in range(20_000))
    assert len(blocks.squeezed(grams.pack_words([once] * 5))) < len(once) / 4


def test_sparse_columns_come_back():
    columns = [np.array([0, 3, 0, 0, 900, 0, 0, 0, 1]), np.array([0, 0, 0, 7, 0, 0, 0, 0, 2])]
    data = blocks.squeezed(blocks.pack_sparse(columns))
    assert [c.tolist() for c in blocks.unpack_sparse(data)] == [c.tolist() for c in columns]
    assert blocks.unpack_sparse(blocks.pack_sparse([np.zeros(0, int)]))[0].tolist() == []


def test_numbers_in_order_with_their_places():
    rng = np.random.default_rng(5)
    top = np.iinfo(np.uint64).max
    few = rng.integers(0, 50, 1000).astype(np.uint64)
    near = (rng.integers(0, 200, 5000).astype(np.uint64) << np.uint64(56)) + rng.integers(0, 3, 5000).astype(np.uint64)
    wide = rng.integers(0, top, 70_000, np.uint64, endpoint=True)
    some = wide.copy()
    some[:40] = some[40:80] + np.uint64(1)
    ends = np.array([top, 0, top, 1], np.uint64)
    for values in (few, near, wide, some, ends, few[:1], few[:0], np.full(9, top, np.uint64)):
        order, ranked = blocks.ordered(values)
        assert ranked.tolist() == sorted(values.tolist())
        assert values[order].tolist() == ranked.tolist()
        assert sorted(order.tolist()) == list(range(len(values)))
