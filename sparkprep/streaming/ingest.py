"""Incremental ingest and cleaning with Structured Streaming.

Row-wise steps and rules run on a stream as they are. Fills that need a
statistic take it from a batch table (``stats``); reports are made per batch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sparkprep.operators.duplicates import remove_duplicates_within
from sparkprep.operators.profile import (
    STATE_COLUMNS,
    merged_states,
    profile_of_states,
    profile_state,
)
from sparkprep.operators.validate import Rule, any_failure, validation_report
from sparkprep.sources.readers import DEFAULT_FORMAT
from sparkprep.sources.replace import replace_folder
from sparkprep.sources.sinks import IS_ERROR

__all__ = [
    "file_stream",
    "for_batches",
    "compact_profile",
    "ingest",
    "ingest_split",
    "profile_batches",
    "read_profile",
    "remove_duplicates_within",
    "report_batches",
]


def file_stream(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    fmt: str = DEFAULT_FORMAT,
    files_per_batch: int | None = None,
    archive: str | None = None,
    **options: str,
) -> DataFrame:
    """New files of a folder as a stream. ``archive`` moves files that were
    read into another folder; nothing is ever deleted."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.load(folder)


def ingest(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    fmt: str = DEFAULT_FORMAT,
    partition_by: Sequence[str] = (),
) -> StreamingQuery:
    """Append everything that has arrived to ``path``, then stop.

    The checkpoint remembers what was read: a second run adds only what is new.
    """
    writer = (
        stream.writeStream.format(fmt)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    query = writer.start(path)
    query.awaitTermination()
    return query


def ingest_split(
    stream: DataFrame,
    rules: Sequence[Rule],
    path: str,
    checkpoint: str,
    fmt: str = DEFAULT_FORMAT,
) -> StreamingQuery:
    """Append clean and error rows to ``path``, for ``sinks.read_split``."""
    marked = stream.withColumn(IS_ERROR, any_failure(stream, rules))
    return ingest(marked, path, checkpoint, fmt, partition_by=[IS_ERROR])


def report_batches(
    stream: DataFrame, rules: Sequence[Rule], path: str, checkpoint: str
) -> StreamingQuery:
    """Write one validation report per batch to ``path``, by ``batch_id``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        # A repeated batch replaces its own report.
        report = validation_report(batch, rules)
        report.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return for_batches(stream, write, checkpoint)


def profile_batches(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep a profile of all that has arrived under ``path``, for ``read_profile``.

    Each batch adds the state of its profile, a row per column, and a repeated
    batch replaces its own; so the state grows with the batches and not the rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        state = profile_state(batch)
        state.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return for_batches(stream, write, checkpoint)


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """(column, rows, missing, mean, median, mode) of all batches so far, see ``profile_of_states``."""
    return profile_of_states(spark.read.parquet(path).select("column", *STATE_COLUMNS))


def compact_profile(spark: SparkSession, path: str) -> None:
    """Merge the states of all batches but the last, which may yet be repeated."""
    states = spark.read.parquet(path)
    last = states.agg(F.max("batch_id")).first()[0]
    earlier = states.where(F.col("batch_id") < last) if last is not None else states
    number = earlier.agg(F.max("batch_id")).first()[0]
    if number is not None:
        merged = merged_states(earlier).withColumn("batch_id", F.lit(number))
        kept = merged.unionByName(states.where(F.col("batch_id") == last))
        replace_folder(kept, path, partition_by=["batch_id"])


def for_batches(
    stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
