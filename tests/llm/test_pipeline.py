"""The stages against plain versions, each on what the one before it kept."""

from collections import Counter, defaultdict

import pytest
from conftest import FOLDER
from test_decontamination import plain as plain_hits
from test_language_id import plain as plain_languages
from test_mixing import levels
from test_simhash import plain_classes

import corpus_pipeline


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage keeps of the smallest tables, as lists of rows, input first."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    schema = docs.schema
    odd = [
        (None, "the end of it", "en", "s", 13),
        (9_000, None, "en", "s", 0),
        (9_001, "", None, None, 0),
        (9_002, "123 %%%", "en", None, 7),
        (9_003, "a text of its own without any source", None, None, 36),
        (9_003, "a text of its own without any source", None, None, 36),
    ]
    docs = docs.unionByName(spark.createDataFrame(odd, schema))
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, docs, FOLDER)
        out.append(frame.collect())
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert frame.columns == docs.columns
            docs = spark.createDataFrame(out[-1], schema)
    return out


def in_order(rows):
    return sorted(map(tuple, rows), key=str)


def test_stages_are_in_order():
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "decontamination", "mixing", "sharding"]


def test_language(kept):
    from zlib import crc32

    # The plain version learns where id % 5; ids are renumbered to say the same.
    rows = []
    for at, r in enumerate(kept[0]):
        learns = crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 != 0
        rows.append((at * 5 + learns, r.text, r.lang))
    langs = {i // 5: lang for i, lang, _ in plain_languages(rows, 300)}
    wanted = [r for at, r in enumerate(kept[0]) if langs[at] != "und"]
    assert in_order(kept[1]) == in_order(wanted)


def test_near_duplicates(kept):
    rows = [(r.doc_id, r.text) for r in kept[1]]
    stays = {i for i, _, component in plain_classes(rows) if i is not None and i == component}
    wanted = {tuple(r) for r in kept[1] if r.doc_id in stays or r.doc_id is None}
    assert in_order(kept[2]) == in_order(wanted)


def test_contamination(kept, spark):
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()
    rows = [(at, r.text) for at, r in enumerate(kept[2])]
    bad = {i for i, _, hit, _, _ in plain_hits(rows, list(map(tuple, items)), 10) if hit}
    assert bad
    wanted = [r for at, r in enumerate(kept[2]) if at not in bad]
    assert in_order(kept[3]) == in_order(wanted)


def test_mixing(kept):
    sizes, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in kept[3]:
        n = len(r.text.split())
        sizes[r.source] += n
        longest[r.source] = max(longest[r.source], n)
    for r in kept[4]:
        taken[r.source] += len(r.text.split())
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    targets = levels(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 3)
    assert all(abs(taken[s] - targets[s]) <= longest[s] / 2 + 1e-6 for s in sizes)
    before, after = Counter(map(tuple, kept[3])), Counter(map(tuple, kept[4]))
    assert all(n <= 3 * before[row] for row, n in after.items())


def test_sharding(kept):
    assert Counter(r.doc_id for r in kept[5]) == Counter(r.doc_id for r in kept[4])
    slots = defaultdict(list)
    for r in kept[5]:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_run_is_the_stages_in_order(spark):
    found = corpus_pipeline.run(spark, FOLDER)
    assert {"doc_id", "shard", "slot"} <= set(found.columns)
    assert 0 < found.select("doc_id").distinct().count() < 200
