"""Search against a plain scorer that looks at every document for every query."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkprep.llm import lexical_search
from sparkprep.session import new_path

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(CAPITALS))


def plain(docs, items, k=20):
    """Rows (item_id, rank, doc_id, score), sorted."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in counts:
            m = 100 - 25 + (25 * c.total() * n_docs) // n_terms
            score = 0
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        for rank, (score, _, _, doc) in enumerate(sorted(scored, key=lambda s: s[:3])[:k], 1):
            out.append((item, rank, doc, -score))
    return sorted(out, key=repr)


def found(spark, docs, items, **more):
    queries = spark.createDataFrame(items, "item_id bigint, text string, score int, query int")
    index = lexical_search.build_index(docs, new_path(spark, "test-search"))
    rows = lexical_search.search(index, queries, **more).collect()
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in rows), key=repr)


def wide(items):
    return [(i, t, None, None) for i, t in items]


def test_table(spark, texts, docs):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()
    items = [(r.item_id, r.text) for r in items]
    assert found(spark, docs(texts, 5), wide(items)) == plain(texts, items)


def test_odd_documents_and_queries(spark, odd, docs):
    items = [(1, "word a B c"), (2, None), (3, ""), (4, "unheard"), (5, "one one ONE"), (6, "日本 ß"), (6, "日本 ß"), (None, "the end")]
    assert found(spark, docs(odd), wide(items)) == plain(odd, items)


def test_ties_are_ranked_by_id(spark, docs):
    rows = [(i, "same text here") for i in range(100, 0, -1)] + [(None, "same text here")] * 3
    rows += [(500 + i, f"filler {i}") for i in range(50)]
    items = [(1, "same text"), (2, "filler 7")]
    assert found(spark, docs(rows, 7), wide(items)) == plain(rows, items)
    assert found(spark, docs(rows, 7), wide(items), k=102) == plain(rows, items, 102)


def test_id_limits(spark, docs):
    rows = [(2**63 - 1, "x y"), (-(2**63), "x y"), (None, "x y"), (0, "x"), (3, "z")]
    assert found(spark, docs(rows), wide([(1, "x")])) == plain(rows, [(1, "x")])


def test_many_passes_and_groups(spark, texts, docs, monkeypatch):
    monkeypatch.setattr(lexical_search, "GROUP_ITEMS", 2)
    items = [(i, t[:200]) for i, t in texts[:9] if t]
    assert found(spark, docs(texts), wide(items), pass_bytes=900) == plain(texts, items)


@pytest.mark.parametrize("rows, items", [([], [(1, "a")]), ([(1, "a")], []), ([(1, None), (2, "")], [(1, "a")])])
def test_empty_tables(spark, docs, rows, items):
    frame = docs(rows) if rows else spark.createDataFrame([], "doc_id bigint, text string")
    assert found(spark, frame, wide(items)) == plain(rows, items)


def test_long_texts_in_slices(spark, docs):
    rows = [(1, "alpha beta " * 250_000), (2, "beta gamma"), (3, "x" * 3_000_000)]
    assert found(spark, docs(rows), wide([(1, "beta")])) == plain(rows, [(1, "beta")])


WORDS = st.sampled_from([f"w{i}" for i in range(12)])
TEXT = st.lists(WORDS, min_size=1, max_size=30)


@settings(max_examples=80, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=30), st.lists(TEXT, min_size=1, max_size=3), st.integers(1, 4))
def test_bounds_hold_and_pruning_loses_nothing(texts, queries, k):
    """One block by hand: bounds are never below the scores, and the best are the best."""
    counts = [Counter(w.encode() for w in t) for t in texts]
    n_docs, n_terms = len(texts), sum(map(len, texts))
    df = Counter(t for c in counts for t in c)
    weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
    group = lexical_search.Group(0, [Counter(w.encode() for w in q) for q in queries])
    group.weigh(weights)
    impacts = [lexical_search.impacts_of(c, n_docs, n_terms) for c in counts]
    batch = pa.RecordBatch.from_pydict(
        {
            "sketch": [lexical_search.sketch_of(list(c), v).tobytes() for c, v in zip(counts, impacts, strict=True)],
            "terms": [b" ".join(c) for c in counts],
            "impacts": [v.astype(np.uint32).tobytes() for v in impacts],
        }
    )
    block = lexical_search.Block(batch, group)
    bounds = block.bounds()
    every = np.column_stack([block.scores(np.arange(n_docs), q) for q in range(len(queries))])
    assert (bounds >= every).all()
    best = [lexical_search.Best(k) for _ in queries]
    ids = np.column_stack((np.zeros(n_docs, np.int64), np.arange(n_docs)))
    lexical_search._search_block(lexical_search.Block(batch, group), ids, best)
    for q, mine in enumerate(best):
        wanted = sorted((-s, i) for i, s in enumerate(every[:, q].tolist()) if s > 0)[:k]
        assert [(-s, i) for s, _, i in mine.rows.tolist()] == wanted


def test_most_documents_are_not_scored(spark):
    """Bounds prune: on texts with rare matching terms few documents are read exactly."""
    rng = np.random.default_rng(3)
    counts = [Counter(f"t{i}".encode() for i in rng.integers(0, 20_000, 100)) for _ in range(2000)]
    n_terms = sum(c.total() for c in counts)
    df = Counter(t for c in counts for t in c)
    group = lexical_search.Group(0, [Counter(list(counts[i])[:12]) for i in range(20)])
    group.weigh({t: math.floor(1000 * math.log(4002 / (2 * d + 1))) for t, d in df.items()})
    best, scored = [lexical_search.Best(20) for _ in range(20)], 0
    for start in range(0, 2000, 250):
        part = counts[start : start + 250]
        values = [lexical_search.impacts_of(c, 2000, n_terms) for c in part]
        batch = pa.RecordBatch.from_pydict(
            {
                "sketch": [lexical_search.sketch_of(list(c), v).tobytes() for c, v in zip(part, values, strict=True)],
                "terms": [b" ".join(c) for c in part],
                "impacts": [v.astype(np.uint32).tobytes() for v in values],
            }
        )
        ids = np.column_stack((np.zeros(250, np.int64), np.arange(start, start + 250)))
        scored += lexical_search._search_block(lexical_search.Block(batch, group), ids, best)
    assert scored < 20 * 2000 / 3
