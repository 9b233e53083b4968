import random

import pytest

from sparkprep.llm import decontamination

LETTERS = set("0123456789abcdefghijklmnopqrstuvwxyz")


def words(text):
    """(word, first place, place behind) one character after the other."""
    out, word, start = [], "", 0
    for at, c in enumerate((text or "") + " "):
        low = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if low in LETTERS or ord(c) > 127:
            start = at if not word else start
            word += low
        elif word:
            out.append((word, start, at))
            word = ""
    return out


def plain(rows, items, window):
    out = []
    for i, text in rows:
        found = words(text)
        hit, names = set(), set()
        for name, item in items:
            w = [x[0] for x in words(item)]
            size = min(window, len(w))
            for a in range(len(w) - size + 1) if w else ():
                for p in range(len(found) - size + 1):
                    if [x[0] for x in found[p : p + size]] == w[a : a + size]:
                        hit.update(range(p, p + size))
                        names.update(() if name is None else (str(name),))
        spans = []
        for p in sorted(hit):
            if spans and spans[-1][2] == p - 1:
                spans[-1] = (spans[-1][0], found[p][2], p)
            else:
                spans.append((found[p][1], found[p][2], p))
        out.append((i, len(found), len(hit), sorted(names), [s[:2] for s in spans]))
    return sorted(out, key=str)


def shown(found):
    return sorted(
        (
            (r.doc_id, r.n_words, r.n_hit, r["items"], [(s.start, s.end) for s in r.spans])
            for r in found.collect()
        ),
        key=str,
    )


@pytest.mark.parametrize("limit", [1 << 20, 60])
def test_against_plain_version(spark, docs, odd, texts, limit, monkeypatch):
    monkeypatch.setattr(decontamination, "AUTOMATON_BYTES", limit)
    draw = random.Random(5)
    items = [(i, " ".join(draw.choices("abcd", k=draw.randint(0, 9)))) for i in range(25)]
    items += [(7, "Ab, CD"), (None, "e f"), (50, None), (51, "日本 語"), (52, texts[3][1][:60])]
    rows = odd + [(100 + i, t[:300]) for i, t in texts[:20]]
    rows += [(200 + i, " ".join(draw.choices("ABCDef-", k=30))) for i in range(30)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontamination.contamination(docs(rows), bench, window=4)
    assert shown(found) == plain(rows, items, 4)


def test_spans_are_of_the_original_text(spark, docs):
    text = "x  The   Quick-brown\nFOX, jumps! y"
    bench = spark.createDataFrame([(1, "the quick brown fox jumps")], "item_id bigint, text string")
    (row,) = decontamination.contamination(docs([(1, text)]), bench).collect()
    assert [text[s.start : s.end] for s in row.spans] == ["The   Quick-brown\nFOX, jumps"]
    assert (row.n_words, row.n_hit, row["items"]) == (7, 5, ["1"])


def test_empty_tables(spark, docs):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert decontamination.contamination(docs([]), bench).collect() == []
    (row,) = decontamination.contamination(docs([(1, "a b")]), bench).collect()
    assert tuple(row) == (1, 2, 0, [], [])


def test_large_benchmarks_are_refused(spark, docs, monkeypatch):
    monkeypatch.setattr(decontamination, "MAX_BENCHMARK_BYTES", 3)
    bench = spark.createDataFrame([(1, "abcd")], "item_id bigint, text string")
    with pytest.raises(ValueError):
        decontamination.contamination(docs([]), bench)
