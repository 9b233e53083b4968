"""Shuffled training shards by a two-pass external shuffle."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.functions.columns import qcol
from sparkprep.llm.shared import fresh

BUCKET_BYTES = 32 * 1024**2


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """The shard with the highest seeded hash for the key.

    Only the key and the number of shards decide. With one more shard, a key
    either stays or goes to the new one.
    """
    scores = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda s: F.struct(F.xxhash64(F.lit(seed), key, s).alias("h"), s.alias("s")),
    )
    return F.array_max(scores)["s"]


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 8


def write_shards(
    docs: DataFrame,
    path: str,
    shards: int,
    seed: int = 0,
    bucket_bytes: int = BUCKET_BYTES,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> tuple[str, str]:
    """Write the rows, all columns kept, in random order under ``path``.

    The folder is partitioned by shard. Returns the names of the two columns
    added, shard and slot (``shard`` and ``slot``, lengthened where the rows
    already have such a column). Slots number the rows of a shard from 0 and
    have no gaps; within a file, rows are in slot order.

    First pass: every row goes to a bucket drawn by seeded hashes, first the
    shard and then one of its buckets, of which there are as many as make a
    bucket of about ``bucket_bytes`` of text. Second pass: each bucket, small
    enough for the memory of a task, is put in a fixed order (so that a lost
    task comes out the same again) and dealt by a seeded Fisher-Yates shuffle. A
    shard is its buckets one after the other: as the draw of the bucket is
    uniform too, any order of a shard's rows is as likely as any other. The text
    is shuffled once.

    The id alone draws the shard (a null id: the text), so equal ids share one.
    The bucket is drawn by id and text. Null texts, empty tables and repeated
    rows need no care; identical rows share a bucket.
    """
    shard, bucket, slot, mark, offset = fresh(docs, "shard", "bucket", "slot", "mark", "offset")
    total = docs.agg(F.sum(text_bytes(qcol(text_column)))).first()[0] or 0
    buckets = max(1, math.ceil(total / shards / bucket_bytes))
    id_, text = qcol(id_column), qcol(text_column)
    key = F.when(id_.isNull(), F.xxhash64(text)).otherwise(id_.cast("bigint"))
    content = F.xxhash64(F.lit(seed + 1), id_, text)
    placed = docs.select(
        "*",
        shard_of(key, shards, seed).alias(shard),
        F.pmod(content, F.lit(buckets)).cast("int").alias(bucket),
        content.alias(mark),
    )
    counts = placed.groupBy(shard, bucket).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(shard).orderBy(bucket)
    before = F.sum("n").over(earlier.rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(shard, bucket, F.coalesce(before, F.lit(0)).alias(offset))

    def deal(table: pa.Table) -> pa.Table:
        table = table.sort_by(mark)
        at = [table.column(c)[0].as_py() for c in (shard, bucket, offset)]
        order = fisher_yates(table.num_rows, (seed, at[0], at[1]))
        slots = pa.array(np.arange(table.num_rows, dtype=np.int64) + at[2])
        out = table.drop_columns([mark, bucket, offset]).take(pa.array(order))
        return out.append_column(slot, slots)

    schema = T.StructType(
        [*docs.schema.fields, T.StructField(shard, T.IntegerType()), T.StructField(slot, T.LongType())]
    )
    dealt = placed.join(offsets, [shard, bucket]).select(*placed.columns, offset)
    rows = dealt.groupBy(shard, bucket).applyInArrow(deal, schema)
    rows.sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
    return shard, slot


def fisher_yates(n: int, seed: tuple[int, ...]) -> np.ndarray:
    """A permutation of 0 to n - 1: swap each place, last first, with one drawn up to it."""
    order = np.arange(n)
    # One draw per place at once; place i gets a number from 0 to i.
    drawn = np.random.default_rng(seed).integers(0, np.arange(n) + 1)
    for i in range(n - 1, 0, -1):
        j = drawn[i]
        order[i], order[j] = order[j], order[i]
    return order


def assignment(
    docs: DataFrame, path: str, shards: int, seed: int = 0, **columns: str
) -> DataFrame:
    """Write the shards, and return where each document went.

    (doc_id, size, text_crc32, law, shard, slot, grown_shard), read back from
    the files. ``law`` is 'key': id and number of shards decide the shard;
    ``grown_shard`` is the one with one shard more. ``size`` is 8 plus the bytes
    of the text; a null text counts as empty there and in the checksum.
    """
    id_name = columns.get("id_column", "doc_id")
    text_name = columns.get("text_column", "text")
    shard, slot = write_shards(docs, path, shards, seed, **columns)
    schema = T.StructType(
        [
            docs.schema[id_name],
            docs.schema[text_name],
            T.StructField(slot, T.LongType()),
            T.StructField(shard, T.IntegerType()),
        ]
    )
    rows = docs.sparkSession.read.schema(schema).parquet(path)
    id_, text = qcol(id_name), qcol(text_name)
    key = F.when(id_.isNull(), F.xxhash64(text)).otherwise(id_.cast("bigint"))
    crc = F.crc32(F.encode(F.coalesce(text, F.lit("")), "utf-8"))
    return rows.select(
        id_.cast("bigint").alias("doc_id"),
        text_bytes(text).alias("size"),
        crc.alias("text_crc32"),
        F.lit("key").alias("law"),
        qcol(shard).alias("shard"),
        qcol(slot).alias("slot"),
        shard_of(key, shards + 1, seed).alias("grown_shard"),
    )
