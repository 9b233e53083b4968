import random

import pytest
import xxhash

from sparkprep.llm import graph, simhash


def plain_fingerprint(text, k=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return "0" * 16
    n = max(1, len(words) - k + 1)
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]), 42) for i in range(n)]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)
    return f"{value:016x}"


def plain_roots(values, d):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for v in values:
        for w in values:
            if v < w and bin((v ^ w) & (2**64 - 1)).count("1") <= d:
                a, b = find(v), find(w)
                root[max(a, b)] = min(a, b)
    return {v: find(v) for v in values}


def plain_classes(rows, d=2):
    marks = [(i, plain_fingerprint(t)) for i, t in rows]
    roots = plain_roots({int(f, 16) for _, f in marks}, d)
    least = {}
    for i, f in marks:
        r = roots[int(f, 16)]
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return sorted(((i, f, least.get(roots[int(f, 16)])) for i, f in marks), key=str)


def test_words_and_odd_rows(docs, odd):
    found = simhash.near_duplicates(docs(odd))
    assert sorted(map(tuple, found.collect()), key=str) == plain_classes(odd)


def test_supplied_table(docs, texts):
    copies = [(10_000 + i, t + " more") for i, t in texts[:40]]
    found = simhash.near_duplicates(docs(texts + copies))
    assert sorted(map(tuple, found.collect()), key=str) == plain_classes(texts + copies)


def test_empty_table(docs):
    assert simhash.near_duplicates(docs([])).collect() == []


@pytest.mark.parametrize("d", [0, 1, 2, 3])
def test_links_connect_what_pairs_connect(spark, d):
    draw = random.Random(d)
    values = [0, -1, -(1 << 63)]
    for _ in range(6):
        at = draw.getrandbits(64)
        for _ in range(25):
            for b in draw.sample(range(64), draw.randint(0, 3)):
                at ^= 1 << b
            values.append(at - (1 << 64) if at >> 63 else at)
    values = sorted(set(values))
    frame = spark.createDataFrame([(v,) for v in values], "fp bigint")
    edges = simhash.links(frame, d)
    found = {r.node: r.root for r in graph.components(edges).collect()}
    assert {v: found.get(v, v) for v in values} == plain_roots(values, d)


def test_long_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)]
    random.Random(1).shuffle(chain)
    edges = spark.createDataFrame(chain, "u bigint, v bigint")
    roots = {r.node: r.root for r in graph.components(edges).collect()}
    assert roots == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)}


def test_only_few_bits_are_taken(docs, odd):
    with pytest.raises(ValueError):
        simhash.near_duplicates(docs(odd), max_bits=9)
