from collections import defaultdict

import pytest

from sparkprep.llm import mixing


def levels(sizes, weights, most):
    """Water-filling by repeating the rule as it is told."""
    held, left = {}, dict(weights)
    while left:
        rest = sum(sizes.values()) - sum(held.values())
        share = {s: rest * w / sum(left.values()) for s, w in left.items()}
        over = [s for s in left if share[s] > most * sizes[s]]
        if not over:
            return held | share
        for s in over:
            held[s] = most * sizes[s]
            del left[s]
    return held


def frame(spark, rows):
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, source string, bin int, need int, its string"
    )


def make(spec):
    rows, i = [], 0
    for source, count, length in spec:
        for _ in range(count):
            rows.append((i, "w " * (length + i % 5), source, None, None, None))
            i += 1
    return rows


@pytest.mark.parametrize(
    "spec",
    [
        [("a", 300, 20), ("b", 100, 30), ("c", 500, 10)],
        [("a", 2, 3), ("b", 5, 4), ("c", 900, 40), (None, 40, 9), ("é", 3, 100), ("Z", 200, 1)],
        [("x", 50, 10)],
        [("x", 50, 0), ("y", 3, 5)],
    ],
)
def test_targets_and_words_taken(spark, spec):
    rows = make(spec)
    found = mixing.mix(frame(spark, rows), seed=1).collect()
    assert sorted(r.doc_id for r in found) == [r[0] for r in rows]
    sizes, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        n = len(r[1].split())
        sizes[r[2]] += n
        largest[r[2]] = max(largest[r[2]], n)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    wanted = levels(sizes, weights, 3)
    taken = defaultdict(int)
    for r in found:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(wanted[r.source])
        assert r.taken == r.size * r.times and 0 <= r.times <= 3
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - wanted[s]) <= largest[s] / 2 + 1e-6


def test_odd_rows_rerun_and_empty(spark):
    rows = [
        (None, "a b", "s", 1, 2, "x"),
        (1, None, "s", 1, 2, "x"),
        (2, "", None, 1, 2, "x"),
        (3, "one two", "t", 1, 2, "x"),
        (3, "one two", "t", 1, 2, "x"),
        (4, "w " * 5000, "t", 1, 2, "x"),
    ]
    one = sorted(map(tuple, mixing.mix(frame(spark, rows)).collect()), key=str)
    two = sorted(map(tuple, mixing.mix(frame(spark, rows[::-1])).collect()), key=str)
    assert one == two and len(one) == len(rows)
    assert mixing.mix(frame(spark, [])).collect() == []
