"""The audit against a plain version with whole tables of shares."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkprep.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, source string, n bigint, term int, shard int"


def plain(rows, min_docs, top):
    """Rows (lang, source, part, item, value, rank) for rows (text, lang, source)."""
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = TERM.findall((text or "").translate(CAPITALS))
        counts[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        sources = [s for la, s in counts if la == lang]

        def shares(found):
            total = sum(found[t] for t in kept) + 5 * len(kept)
            return {t: 1 + (10**9 * (found[t] + 5)) // total for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            over = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, None), ("term", over, top)):
                ranked = sorted(found, key=lambda f: (-f[0], f[1].encode()))[:limit]
                out += [(lang, s, part, item, v, r) for r, (v, item) in enumerate(ranked, 1)]
    return sorted(out)


def found(spark, rows, min_docs, top, **more):
    full = [(i, *row, None, None, None) for i, row in enumerate(rows)]
    frame = spark.createDataFrame(full, SCHEMA).repartition(3)
    names = "lang", "source", "part", "item", "value", "rank"
    audited = divergence.audit(frame, min_docs, top, **more)
    return sorted(tuple(r[n] for n in names) for r in audited.collect())


def table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return [(r.text, r.lang, r.source) for r in frame.collect()]


@pytest.mark.parametrize("postings", [1 << 20, 50])
def test_table(spark, postings):
    rows = table(spark)
    assert found(spark, rows, 3, 5, shard_postings=postings) == plain(rows, 3, 5)


ODD = [
    (None, None, None),
    ("", "", ""),
    ("Alpha beta 12 alpha", "en", "a"),
    ("alpha BETA", "en", "b"),
    ("alpha beta", "en", None),
    ("1234 ...", "en", "no terms"),
    (None, "en", "null text"),
    ("alpha", "de", "alone"),
    ("ä日本 ß É é", "xx", "a"),
    ("ä日本 ß", "xx", "b"),
    ("words", None, "a"),
    ("words words", "", "a"),
    ("words " * 5000, None, "b"),
]


@pytest.mark.parametrize("min_docs", [1, 2, 100])
def test_odd_rows(spark, min_docs):
    assert found(spark, ODD * 2, min_docs, 50) == plain(ODD * 2, min_docs, 50)


def test_hot_group_and_ties(spark):
    rows = [("tie one two three", "en", "hot")] * 400 + [
        (f"tie one w{i % 5}", "en", f"s{i % 7}") for i in range(140)
    ]
    assert found(spark, rows, 10, 3, shard_postings=10) == plain(rows, 10, 3)


def test_counts_passed_on_early(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 10)
    rows = table(spark)[:60]
    assert found(spark, rows, 2, 4) == plain(rows, 2, 4)


def test_empty_table(spark):
    assert found(spark, [], 30, 50) == []


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 1 << 53), st.integers(1, 9 * 10**15))
def test_share_is_exact(count, total):
    total = max(total, count + 5)
    total = min(total, 9 * 10**15)
    wanted = 1 + (10**9 * (count + 5)) // total
    assert divergence.share(np.array([count]), np.array([total])).tolist() == [wanted]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 4), st.integers(1, 50), min_size=1), min_size=1, max_size=8))
def test_accumulated_distances(index):
    """Both parts of a pair sum to the plain distance, whatever the groups share."""
    groups = [g for posting in index for g in posting]
    counts = [n for posting in index for n in posting.values()]
    ends = np.cumsum([len(p) for p in index])
    sums = [sum(p.get(g, 0) for p in index) for g in range(5)]
    totals = np.array(sums) + 5 * len(index)
    shard = divergence.Shard(ends, np.array(groups), np.array(counts), totals, sum(sums) + 5 * len(index))
    halves = [shard.halves(g) for g in range(5)]
    share = [[1 + 10**9 * (p.get(g, 0) + 5) // int(totals[g]) for p in index] for g in range(5)]
    for a in range(5):
        for b in range(a + 1, 5):
            wanted = sum(abs(x - y) for x, y in zip(share[a], share[b], strict=True))
            assert halves[a][b] + halves[b][a] == wanted
