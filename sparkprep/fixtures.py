"""The supplied tables, and dirty versions of them.

The supplied tables hold no missing values, so those are injected. Each dirty
version is a list of SQL expressions that Spark and the checking engine both
understand; ``WITH`` holds them as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)

DIRTY_EVENTS = (
    "event_id",
    "ts",
    "CASE WHEN event_id % 13 = 0 THEN NULL ELSE user_id END AS user_id",
    "CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN '' ELSE event_type END"
    " AS event_type",
    "CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS value",
)

RAW_EVENTS = (
    "event_id",
    "CASE WHEN event_id % 9 = 0 THEN 'n/a' WHEN event_id % 9 = 1"
    " THEN CAST(event_id AS STRING) || '.5' ELSE CAST(event_id AS STRING) END AS raw_value",
    "CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 6 = 1 THEN 'yes'"
    " WHEN event_id % 6 = 2 THEN 'TRUE' ELSE 'false' END AS raw_flag",
    "CASE WHEN event_id % 8 = 0 THEN '2024-02-30' WHEN event_id % 8 = 1 THEN 'soon'"
    " WHEN event_id % 8 = 2 THEN NULL ELSE CAST(CAST(ts AS DATE) AS STRING) END AS raw_time",
)

DIRTY_LINEITEM = (
    "l_orderkey",
    "l_linenumber",
    "CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_quantity END AS l_quantity",
    "CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice",
    "CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag",
    "l_linestatus",
    "l_shipdate",
)


def _select(parts: tuple[str, ...], table: str) -> str:
    return f"SELECT {', '.join(parts)} FROM {table}"


WITH = (
    f"WITH dirty_events AS ({_select(DIRTY_EVENTS, 'events')}), "
    "dup_events AS (SELECT * FROM dirty_events UNION ALL "
    "SELECT * FROM dirty_events WHERE event_id % 20 = 0), "
    f"raw_events AS ({_select(RAW_EVENTS, 'events')}), "
    f"dirty_lineitem AS ({_select(DIRTY_LINEITEM, 'lineitem')}) "
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dirty_events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(*DIRTY_EVENTS)


def dup_events(spark: SparkSession, folder: str) -> DataFrame:
    dirty = dirty_events(spark, folder)
    return dirty.unionAll(dirty.where("event_id % 20 = 0"))


def raw_events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(*RAW_EVENTS)


def dirty_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").selectExpr(*DIRTY_LINEITEM)
