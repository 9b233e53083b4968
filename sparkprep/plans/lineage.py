"""The lineage log: one row per step of a run, kept as a table."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping
from hashlib import md5
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprep.functions.columns import qcol
from sparkprep.functions.ordered import with_predecessor
from sparkprep.plans.cleaning import StepReport
from sparkprep.sources.replace import Files, replace_folder

LOG_SCHEMA = "run_id string, seq int, name string, ts timestamp, details map<string,string>"
ENTRY_SCHEMA = "seq int, name string, details map<string,string>"
# Runs are dealt to so many partitions of the log by a hash of their name.
BUCKETS = 64
BUCKET = "bucket"
CLAIMS, STAGING = "_claims", "_staging"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log; empty before the first entry.

    A filter on ``run_id`` reads all partitions; ``read_run`` reads one.
    """
    if not Files(spark, path).exists(path):
        return spark.createDataFrame([], LOG_SCHEMA)
    return _partitioned(spark, path).drop(BUCKET)


def read_run(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """The entries of one run, from the one partition that has them."""
    if not Files(spark, path).exists(path):
        return spark.createDataFrame([], LOG_SCHEMA)
    mine = (F.col(BUCKET) == bucket_of(run_id)) & (F.col("run_id") == run_id)
    return _partitioned(spark, path).where(mine).drop(BUCKET)


def _partitioned(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{LOG_SCHEMA}, {BUCKET} int").parquet(path)


def bucket_of(run_id: str) -> int:
    return crc32(run_id.encode()) % BUCKETS


def append(
    spark: SparkSession,
    path: str,
    run_id: str,
    entries: Iterable[tuple[str, Mapping[str, object]]],
) -> None:
    """Add (name, details) entries to a run, numbered on from its last one.

    The numbers are claimed by a file that only one of several writers can make, so
    any number of them can add to the same run. The entries are written aside and
    come into the log by one rename: all of them or none. An append that breaks off
    leaves its numbers unused.
    """
    rows = [
        (name, {k: None if v is None else str(v) for k, v in details.items()})
        for name, details in entries
    ]
    if not rows:
        return
    files = Files(spark, path)
    partition_old_log(spark, path)
    start = _claimed(spark, files, path, run_id, len(rows))
    frame = spark.createDataFrame(
        [(start + i, *row) for i, row in enumerate(rows)], ENTRY_SCHEMA
    ).select(
        F.lit(run_id).alias("run_id"), "seq", "name", F.current_timestamp().alias("ts"), "details"
    )
    mark = uuid.uuid4().hex
    aside, place = f"{path}/{STAGING}/{mark}", f"{path}/{BUCKET}={bucket_of(run_id)}"
    frame.coalesce(1).write.parquet(aside)
    files.make_folder(place)
    for at, part in enumerate(c for c in files.children(aside) if c.endswith(".parquet")):
        files.rename(part, f"{place}/{mark}-{at}.parquet")
    files.delete(aside)


def _claimed(spark: SparkSession, files: Files, path: str, run_id: str, n: int) -> int:
    """The first of ``n`` numbers that nobody else has for this run.

    A claim is named by its first number and holds the number after its last.
    """
    folder = f"{path}/{CLAIMS}/{md5(run_id.encode()).hexdigest()}"
    files.make_folder(folder)
    while True:
        claims = [c for c in files.children(folder) if c.rpartition("/")[2].isdigit()]
        if claims:
            start = int(files.read(max(claims)))
        else:
            last = read_run(spark, path, run_id).agg(F.max("seq")).first()[0]
            start = 0 if last is None else last + 1
        if files.claim(f"{folder}/{start:012d}", str(start + n)):
            return start


def partition_old_log(spark: SparkSession, path: str) -> None:
    """Deal a log whose files lie in its folder itself, as they once did, to partitions."""
    files = Files(spark, path)
    if files.exists(path) and any(c.endswith(".parquet") for c in files.children(path)):
        old = spark.read.schema(LOG_SCHEMA).parquet(path)
        dealt = F.pmod(F.crc32(F.encode("run_id", "utf-8")), F.lit(BUCKETS)).cast("int")
        replace_folder(old.withColumn(BUCKET, dealt), path, partition_by=[BUCKET])


def report_entries(report: StepReport) -> list[tuple[str, dict[str, object]]]:
    """Log entries of a run of cleaning steps: shapes, settings, reasons."""
    return [
        (
            r.step,
            {
                "initial_shape": f"({r.initial_rows}, {r.initial_columns})",
                "final_shape": f"({r.final_rows}, {r.final_columns})",
                "status": r.status,
                "reason": r.reason,
                **r.details,
            },
        )
        for r in report.records
    ]


def edges(log: DataFrame, run: str = "run_id", seq: str = "seq") -> DataFrame:
    """(run, previous, current): each step of a run and the one before it."""
    linked = with_predecessor(log.select(qcol(run), qcol(seq)), run, seq)
    return linked.where(F.col("previous").isNotNull()).select(
        qcol(run), "previous", qcol(seq).alias("current")
    )


def labels(
    log: DataFrame,
    run: str = "run_id",
    seq: str = "seq",
    name: str = "name",
    details: str = "details",
) -> DataFrame:
    """(run, seq, label): ``Step n: name`` and, on a second line, the details
    that have a value."""
    # The label's parts and the text that stands for no value.
    shown = F.map_filter(qcol(details), lambda k, v: v.isNotNull() & (v != "None"))
    pairs = F.transform(F.map_entries(shown), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    listed = F.array_join(pairs, ", ")
    placed = with_predecessor(log, run, seq, previous="_previous", position="_position")
    heading = F.concat(F.lit("Step "), F.col("_position").cast("string"), F.lit(": "), qcol(name))
    label = F.when(
        F.coalesce(listed, F.lit("")) != "", F.concat(heading, F.lit("\n("), listed, F.lit(")"))
    ).otherwise(heading)
    return placed.select(qcol(run), qcol(seq), label.alias("label"))
