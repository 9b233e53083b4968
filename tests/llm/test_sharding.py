import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from sparkprep.llm import sharding
from sparkprep.session import new_path


def check(rows, found, shards):
    assert Counter(r.doc_id for r in found) == Counter(i for i, _ in rows)
    by_shard = defaultdict(list)
    for r in found:
        by_shard[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert set(by_shard) <= set(range(shards))
    want = Counter((i, 8 + len((t or "").encode()), zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == want
    assert all(r.law == "key" and r.grown_shard in (r.shard, shards) for r in found)


def test_odd_rows(docs, odd, spark):
    frame = docs(odd)
    found = sharding.assignment(frame, new_path(spark, "s"), 3).collect()
    check(odd, found, 3)
    again = sharding.assignment(frame.repartition(1), new_path(spark, "s"), 3).collect()
    assert Counter(map(tuple, found)) == Counter(map(tuple, again))


def test_supplied_table_in_small_buckets(docs, texts, spark):
    path = new_path(spark, "s")
    frame = docs(texts)
    shard, slot = sharding.write_shards(frame, path, 5, seed=3, bucket_bytes=20_000)
    written = spark.read.parquet(path)
    assert (shard, slot) == ("shard_", "slot")
    rows = written.select("doc_id", "text", F.col(shard).alias("s"), slot).collect()
    assert sorted((r.doc_id, r.text) for r in rows) == texts
    order = defaultdict(dict)
    for r in rows:
        order[r.s][r.slot] = r.doc_id
    for places in order.values():
        ids = [places[i] for i in range(len(places))]
        assert ids != sorted(ids)
    grown = {r.doc_id: r.g for r in frame.select("doc_id", sharding.shard_of(F.col("doc_id"), 6, 3).alias("g")).collect()}
    assert all(grown[r.doc_id] in (r.s, 5) for r in rows)
    assert 0 < sum(g == 5 for g in grown.values()) < len(rows) / 2


def test_empty_table(docs, spark):
    assert sharding.assignment(docs([]), new_path(spark, "s"), 24).collect() == []


def test_every_permutation_is_as_likely():
    seen = Counter(tuple(sharding.fisher_yates(4, (s,)).tolist()) for s in range(4800))
    assert len(seen) == 24 and all(130 < n < 280 for n in seen.values())
    assert sorted(sharding.fisher_yates(1000, (1, 2))) == list(range(1000))
    assert isinstance(sharding.fisher_yates(0, (1,)), np.ndarray)
