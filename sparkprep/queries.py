"""Every operator as a query over the supplied tables, with SQL to check it.

``@query(name, sql)`` registers a function (spark, folder) -> DataFrame. The SQL
gives the same columns and rows in the checking engine; ``WITH`` from
``fixtures`` defines the dirty tables for it. Queries that need files or
tables of another format have Spark write the supplied data in that format
first.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep import fixtures as fx
from sparkprep.fixtures import WITH, table
from sparkprep.functions import columns as cols
from sparkprep.operators import fill, filters, profile, projections, validate
from sparkprep.operators.duplicates import remove_duplicates
from sparkprep.operators.validate import ColumnExists, NotNull, OfType
from sparkprep.plans import cleaning, job, lineage, steps
from sparkprep.session import new_path
from sparkprep.sources import catalog, ledger, readers, sinks
from sparkprep.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


# --- sources --------------------------------------------------------------

CSV_COLUMNS = ("event_id", "user_id", "event_type", "value", "props")
CSV_SQL = "SELECT event_id, user_id, event_type, value, props FROM events"


def _csv_events(spark: SparkSession, folder: str, header: bool = True, delimiter: str = ",") -> str:
    path = new_path(spark, "csv")
    events = table(spark, folder, "events").select(*CSV_COLUMNS)
    sinks.write_csv(events, path, header=header, delimiter=delimiter)
    return path


@query("scan_csv", CSV_SQL)
def scan_csv(spark, folder):
    return readers.read_csv(spark, _csv_events(spark, folder))


@query("scan_csv_schema", CSV_SQL)
def scan_csv_schema(spark, folder):
    schema = table(spark, folder, "events").select(*CSV_COLUMNS).schema
    return readers.read_csv(
        spark, _csv_events(spark, folder, delimiter=";"), delimiter=";", schema=schema
    )


@query("scan_csv_folder", CSV_SQL + " UNION ALL " + CSV_SQL)
def scan_csv_folder(spark, folder):
    """Files whose headers are the same, quoted in some and not in others."""
    events = table(spark, folder, "events").select(*CSV_COLUMNS)
    path = _csv_events(spark, folder)
    quoted = {**sinks.CSV_OPTIONS, "quoteAll": "true"}
    events.write.mode("append").options(**quoted).csv(path)
    return readers.read_csv(spark, path, schema=events.schema)


@query(
    "scan_csv_headerless",
    'SELECT event_id AS "0", user_id AS "1", event_type AS "2", value AS "3", props AS "4"'
    " FROM events",
)
def scan_csv_headerless(spark, folder):
    return readers.read_csv(spark, _csv_events(spark, folder, header=False), header=False)


@query(
    "normalize_na",
    WITH + "SELECT event_id, CASE WHEN raw_value = 'n/a' THEN NULL ELSE raw_value END"
    " AS raw_value, raw_flag, raw_time FROM raw_events",
)
def normalize_na(spark, folder):
    return cols.normalize_na(fx.raw_events(spark, folder))


@query(
    "normalize_na_cast",
    WITH + "SELECT event_id, CASE WHEN raw_value = 'n/a' THEN NULL"
    " ELSE CAST(raw_value AS DOUBLE) END AS raw_value FROM raw_events",
)
def normalize_na_cast(spark, folder):
    raw = fx.raw_events(spark, folder).select("event_id", "raw_value")
    return readers.infer_types(cols.normalize_na(raw))


@query(
    "canonicalize_nan",
    "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS value FROM events",
)
def canonicalize_nan(spark, folder):
    events = table(spark, folder, "events").selectExpr(
        "event_id", "CASE WHEN event_id % 10 = 0 THEN double('NaN') ELSE value END AS value"
    )
    return cols.canonicalize_nan(events)


JSON_SQL = "SELECT conv_id, turn, role, text FROM conversations"


@query("scan_json", JSON_SQL)
def scan_json(spark, folder):
    path = new_path(spark, "json")
    conversations = table(spark, folder, "conversations")
    conversations.write.json(path)
    return readers.read_json(spark, path, conversations.schema, lines=True)


def _json_array(spark: SparkSession, folder: str) -> str:
    """The conversations as files of one JSON array each."""

    def as_array(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Lines of one JSON array made of all the records of a partition."""
        mark = "["
        for batch in batches:
            marks = pd.Series(",", index=batch.index)
            if len(marks):
                marks.iloc[0], mark = mark, ","
            yield pd.DataFrame({"value": marks + batch["value"]})
        yield pd.DataFrame({"value": ["]" if mark == "," else "[]"]})

    path = new_path(spark, "json-array")
    conversations = table(spark, folder, "conversations")
    records = conversations.select(F.to_json(F.struct("*")).alias("value"))
    records.mapInPandas(as_array, "value string").write.text(path)
    return path


@query("scan_json_array", JSON_SQL)
def scan_json_array(spark, folder):
    schema = table(spark, folder, "conversations").schema
    return readers.read_json(spark, _json_array(spark, folder), schema)


@query("load_json_to_table", JSON_SQL + " UNION ALL " + JSON_SQL)
def load_json_to_table(spark, folder):
    """Both forms of JSON, told apart by the files themselves."""
    lines = new_path(spark, "json")
    table(spark, folder, "conversations").write.json(lines)
    names = []
    for path in (lines, _json_array(spark, folder)):
        names.append(f"sparkprep_loaded_{uuid.uuid4().hex}")
        sinks.load_file_to_table(
            spark, path, names[-1], {"format": "JSON"}, path=new_path(spark, "loaded")
        )
    return spark.table(names[0]).unionByName(spark.table(names[1]))


BROKEN_LINES = "concat(text, '\\n', '\"', source, '\",\\r\\n', text)"


@query(
    "scan_csv_multiline",
    "SELECT doc_id, concat(text, chr(10), '\"', source, '\",', chr(13), chr(10), text) AS text,"
    " lang FROM documents",
)
def scan_csv_multiline(spark, folder):
    path = new_path(spark, "csv")
    docs = table(spark, folder, "documents").selectExpr("doc_id", f"{BROKEN_LINES} AS text", "lang")
    sinks.write_csv(docs, path, multi_line=True)
    schema = "doc_id bigint, text string, lang string"
    return readers.read_file(
        spark, path, {"format": "CSV", "multi_line": True, "schema": schema}
    )


@query(
    "scan_parquet",
    "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_returnflag = 'R'",
)
def scan_parquet(spark, folder):
    lineitem = readers.read_parquet(spark, f"{folder}/lineitem.parquet")
    return lineitem.where("l_returnflag = 'R'").select("l_orderkey", "l_quantity")


@query("scan_path", "SELECT * FROM orders")
def scan_path(spark, folder):
    return readers.read_path(spark, f"{folder}/orders.parquet")


def _saved_table(spark: SparkSession, df: DataFrame, label: str) -> str:
    name = f"sparkprep_{label}_{uuid.uuid4().hex}"
    sinks.write_table(df, name, path=new_path(spark, label))
    return name


@query("scan_table", "SELECT * FROM customer")
def scan_table(spark, folder):
    return readers.read_table(spark, _saved_table(spark, table(spark, folder, "customer"), "scan"))


@query("scan_sql", "SELECT * FROM part")
def scan_sql(spark, folder):
    return readers.read_sql(spark, _saved_table(spark, table(spark, folder, "part"), "scan"))


SIZES_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS name, count(*) AS rows FROM {n}" for n in fx.TABLES
)


@query("list_tables", SIZES_SQL)
def list_tables(spark, folder):
    prefix = f"listed_{uuid.uuid4().hex}_"
    for name in fx.TABLES:
        table(spark, folder, name).createOrReplaceTempView(prefix + name)
    listed = catalog.list_tables(spark).where(F.col("name").startswith(prefix))
    sizes = catalog.table_sizes(spark, [prefix + n for n in fx.TABLES])
    shown = F.substring(F.col("name"), len(prefix) + 1, 1000).alias("name")
    return listed.join(sizes, "name").select(shown, "rows")


@query(
    "list_files",
    f"SELECT name || '.parquet' AS file_name, rows FROM ({SIZES_SQL})",
)
def list_files(spark, folder):
    listed = catalog.list_files(spark, folder, "*.parquet").select("file_name")
    counts = [
        table(spark, folder, n).agg(
            F.lit(f"{n}.parquet").alias("file_name"), F.count(F.lit(1)).alias("rows")
        )
        for n in fx.TABLES
    ]
    return listed.join(reduce(DataFrame.unionByName, counts), "file_name")


@query(
    "ingest_new_files",
    "SELECT doc_id, n_chars FROM documents d"
    " WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
)
def ingest_new_files(spark, folder):
    listing = table(spark, folder, "documents").select("doc_id", "n_chars")
    return ledger.new_arrivals(listing, table(spark, folder, "labels"), keys=["doc_id"])


@query(
    "ingest_batches",
    "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier",
)
def ingest_batches(spark, folder):
    source, target, log = (new_path(spark, n) for n in ("arrivals", "loaded", "ledger"))
    supplier = table(spark, folder, "supplier")

    def load(paths: list[str]) -> None:
        spark.read.parquet(*paths).write.mode("append").parquet(target)

    supplier.write.parquet(source)
    ledger.ingest_new_files(spark, source, log, load, pattern="*.parquet")
    ledger.ingest_new_files(spark, source, log, load, pattern="*.parquet")
    return spark.read.parquet(target)


@query("ingest_batches_alike", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def ingest_batches_alike(spark, folder):
    """Files that share name and size, in the folders of their partitions, one per batch."""
    source, target, log = (new_path(spark, n) for n in ("arrivals", "loaded", "ledger"))
    supplier = table(spark, folder, "supplier")
    for day in range(3):
        part = supplier.where(F.col("s_suppkey") % 3 == day)
        rows = part.select(F.to_json(F.struct("*")).alias("value")).coalesce(1)
        padded = rows.select(F.rpad("value", 400, " ").alias("value"))
        padded.write.text(f"{source}/day={day}")

    def load(paths: list[str]) -> None:
        spark.read.schema(supplier.schema).json(paths).write.mode("append").parquet(target)

    for _ in range(2):
        ledger.ingest_new_files(spark, source, log, load, pattern="*.txt", batch_files=1)
    return spark.read.parquet(target)


# --- streams --------------------------------------------------------------


@query("ingest_after_failure", "SELECT event_id, user_id, event_type, value FROM events")
def ingest_after_failure(spark, folder):
    """A load that breaks off after its write, and a second run: each file is there once."""
    source, ledger_path, output = (new_path(spark, n) for n in ("arriving", "ledger", "once"))
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type", "value")
    events.repartition(6).write.parquet(source)

    def read(paths: list[str]) -> DataFrame:
        return spark.read.schema(events.schema).parquet(*paths)

    def broken(number: int) -> None:
        if number == 1:
            raise InterruptedError("lost after the rows were written")

    once = partial(ledger.ingest_once, spark, source, ledger_path, read, output, "*.parquet")
    try:
        once(batch_files=2, written=broken)
    except InterruptedError:
        once(batch_files=4)
    return spark.read.parquet(output).drop(ledger.BATCH)


def _event_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = table(spark, folder, "events").schema
    return ingest.file_stream(spark, f"{folder}/events*.parquet", schema)


def _ingested(spark: SparkSession, stream: DataFrame) -> DataFrame:
    path = new_path(spark, "ingested")
    ingest.ingest(stream, path, new_path(spark, "progress"))
    return spark.read.schema(stream.schema).parquet(path)


@query(
    "ingest_stream",
    WITH + "SELECT event_id, ts, user_id, event_type, value FROM dirty_events"
    " WHERE value IS NOT NULL AND event_type IS NOT NULL",
)
def ingest_stream(spark, folder):
    dirty = _event_stream(spark, folder).selectExpr(*fx.DIRTY_EVENTS)
    return _ingested(spark, validate.clean_rows(dirty, RULES))


@query(
    "ingest_stream_fill",
    WITH + "SELECT event_id, round(coalesce(value, m), 6) AS value, coalesce(event_type, t)"
    " AS event_type FROM dirty_events CROSS JOIN (SELECT avg(value) AS m FROM dirty_events)"
    " CROSS JOIN (SELECT event_type AS t FROM dirty_events WHERE event_type IS NOT NULL"
    " GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1)",
)
def ingest_stream_fill(spark, folder):
    dirty = _event_stream(spark, folder).selectExpr(*fx.DIRTY_EVENTS)
    plan = [steps.FillNulls("value", "fill_mean"), steps.FillNulls("event_type", "fill_mode")]
    filled = cleaning.apply_steps(dirty, plan, stats=fx.dirty_events(spark, folder))
    return _ingested(spark, filled).select("event_id", F.round("value", 6).alias("value"), "event_type")


@query(
    "ingest_stream_filter_then_fill",
    WITH + "SELECT event_id, round(coalesce(value, m), 6) AS value FROM dirty_events"
    " CROSS JOIN (SELECT avg(value) AS m FROM dirty_events WHERE user_id IS NOT NULL"
    " AND event_type = 'signup') WHERE user_id IS NOT NULL AND event_type = 'signup'",
)
def ingest_stream_filter_then_fill(spark, folder):
    dirty = _event_stream(spark, folder).selectExpr(*fx.DIRTY_EVENTS)
    plan = [
        steps.RemoveNulls("drop_rows_col", ("user_id",)),
        steps.FilterEquals("event_type", "signup"),
        steps.FillNulls("value", "fill_mean"),
    ]
    filled = cleaning.apply_steps(dirty, plan, stats=fx.dirty_events(spark, folder))
    return _ingested(spark, filled).select("event_id", F.round("value", 6).alias("value"))


@query(
    "ingest_stream_dedup",
    WITH + "SELECT DISTINCT event_id, ts, user_id, event_type, value FROM dup_events",
)
def ingest_stream_dedup(spark, folder):
    dirty = _event_stream(spark, folder).selectExpr(*fx.DIRTY_EVENTS)
    doubled = dirty.unionAll(
        _event_stream(spark, folder).selectExpr(*fx.DIRTY_EVENTS).where("event_id % 20 = 0")
    )
    unique = ingest.remove_duplicates_within(doubled, "ts", "1 hour")
    return _ingested(spark, unique).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    "ingest_stream_split",
    WITH + "SELECT *, (value IS NULL OR event_type IS NULL) AS is_error FROM dirty_events",
)
def ingest_stream_split(spark, folder):
    path = new_path(spark, "ingested")
    dirty = _event_stream(spark, folder).selectExpr(*fx.DIRTY_EVENTS)
    ingest.ingest_split(dirty, RULES, path, new_path(spark, "progress"))
    return _both_sides(*sinks.read_split(spark, path))


@query(
    "ingest_stream_report",
    WITH + "SELECT 'not_null(value)' AS rule, count(*) AS element_count,"
    " count(*) - count(value) AS unexpected_count FROM dirty_events UNION ALL"
    " SELECT 'not_null(event_type)', count(*), count(*) - count(event_type) FROM dirty_events",
)
def ingest_stream_report(spark, folder):
    path = new_path(spark, "reports")
    dirty = _event_stream(spark, folder).selectExpr(*fx.DIRTY_EVENTS)
    ingest.report_batches(dirty, RULES, path, new_path(spark, "progress"))
    reports = spark.read.parquet(path).groupBy("rule")
    return reports.agg(
        F.sum("element_count").alias("element_count"),
        F.sum("unexpected_count").alias("unexpected_count"),
    )


@query(
    "ingest_stream_profile",
    WITH
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS \"rows\", count(*) - count({c}) AS missing, {mean} AS mean"
        " FROM dirty_events"
        for c, mean in (
            ("event_id", "round(avg(event_id), 6)"),
            ("user_id", "round(avg(user_id), 6)"),
            ("event_type", "CAST(NULL AS DOUBLE)"),
            ("value", "round(avg(value), 6)"),
        )
    ),
)
def ingest_stream_profile(spark, folder):
    """The profile of a stream of several batches, merged from a state per batch."""
    source, path = new_path(spark, "arriving"), new_path(spark, "profile")
    dirty = fx.dirty_events(spark, folder).select("event_id", "user_id", "event_type", "value")
    dirty.repartition(3).write.parquet(source)
    stream = ingest.file_stream(spark, source, dirty.schema, files_per_batch=1)
    ingest.profile_batches(stream, path, new_path(spark, "progress"))
    return ingest.read_profile(spark, path).select("column", "rows", "missing", "mean")


# --- sinks ----------------------------------------------------------------


@query(
    "sink_table",
    WITH + "SELECT * FROM dirty_lineitem WHERE l_quantity IS NOT NULL",
)
def sink_table(spark, folder):
    kept = filters.drop_missing(fx.dirty_lineitem(spark, folder), ["l_quantity"])
    return spark.table(_saved_table(spark, kept, "sink"))


@query(
    "null_removal_table",
    WITH + "SELECT * FROM dirty_events WHERE event_type IS NOT NULL AND value IS NOT NULL",
)
def null_removal_table(spark, folder):
    source = _saved_table(spark, fx.dirty_events(spark, folder), "source")
    target = f"sparkprep_target_{uuid.uuid4().hex}"
    cleaning.remove_nulls_from_table(
        spark, source, target, '["event_type", "value"]', path=new_path(spark, "target")
    )
    return spark.table(target)


@query("load_file_to_table", CSV_SQL)
def load_file_to_table(spark, folder):
    name = f"sparkprep_loaded_{uuid.uuid4().hex}"
    options = {"format": "CSV", "header": True, "delimiter": "|"}
    sinks.load_file_to_table(
        spark,
        _csv_events(spark, folder, delimiter="|"),
        name,
        options,
        path=new_path(spark, "loaded"),
    )
    return spark.table(name)


@query(
    "overwrite_table_in_place",
    "SELECT event_id, user_id, event_type, event_id % 10 AS part, 'EXTERNAL' AS kind, 'part' AS partitioned_by,"
    " 'kept' AS note FROM events WHERE value IS NOT NULL AND event_id % 10 < 6 AND event_id % 4 <> 1",
)
def overwrite_table_in_place(spark, folder):
    """An external, partitioned table overwritten from itself, then from its own folder."""
    name, path = f"sparkprep_in_place_{uuid.uuid4().hex}", new_path(spark, "in-place")
    events = table(spark, folder, "events").selectExpr("*", "event_id % 10 AS part")
    sinks.write_table(events, name, path=path, partition_by=["part"])
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('note' = 'kept')")
    sinks.overwrite_source_table(spark.table(name).where("value IS NOT NULL AND part < 6"), name)
    files = readers.read_path(spark, path).where("event_id % 4 <> 1")
    sinks.overwrite_source_table(files.select("event_id", "user_id", "event_type", "part"), name)
    told = json.loads(spark.sql(f"DESCRIBE TABLE EXTENDED {name} AS JSON").first()[0])
    return spark.table(name).select(
        "*",
        F.lit(told["type"]).alias("kind"),
        F.lit(",".join(told["partition_columns"])).alias("partitioned_by"),
        F.lit(told["table_properties"]["note"]).alias("note"),
    )


AWKWARD_TEXT = (
    "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN ' x ' WHEN 2 THEN NULL"
    " WHEN 3 THEN concat('\"', text, ',\"') WHEN 4 THEN '  ' ELSE text END AS text, lang FROM documents"
)


@query("csv_table_text", AWKWARD_TEXT)
def csv_table_text(spark, folder):
    """Empty texts, spaces, nulls, quotes and line breaks in a table of CSV files."""
    table(spark, folder, "documents").createOrReplaceTempView("sparkprep_documents")
    docs = spark.sql(AWKWARD_TEXT.replace("documents", "sparkprep_documents"))
    name = f"sparkprep_csv_{uuid.uuid4().hex}"
    options = {"multiLine": "true"}
    sinks.write_table(docs, name, "csv", path=new_path(spark, "csv-table"), options=options)
    spark.catalog.dropTempView("sparkprep_documents")
    return spark.table(name)


@query(
    "job_split_csv",
    "SELECT doc_id, concat(text, chr(10), source) AS text, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE lang END AS lang,"
    " doc_id % 5 = 0 AS is_error FROM documents",
)
def job_split_csv(spark, folder):
    """A job whose clean and error rows go to CSV files, with line breaks in their text."""
    docs = table(spark, folder, "documents").selectExpr(
        "doc_id", "concat(text, '\\n', source) AS text", "IF(doc_id % 5 = 0, NULL, lang) AS lang"
    )
    split, options = new_path(spark, "job-split"), {"multiLine": True}
    spec = {
        "source": {"table": _saved_table(spark, docs, "split_source")},
        "validation_config": {"suite": json.loads(validate.suite_to_json((NotNull("lang"),)))},
        "split_path": split,
        "split_format": "csv",
        "split_options": options,
        "output_table": f"sparkprep_job_{uuid.uuid4().hex}",
        "output_path": new_path(spark, "job"),
    }
    # A second run replaces what the first one wrote.
    for _ in range(2):
        job.run_job(spark, json.dumps(spec))
    return _both_sides(*sinks.read_split(spark, split, "csv", {"multiLine": "true"}))


SPLIT_SQL = (
    WITH + "SELECT *, (value IS NULL OR event_type IS NULL) AS is_error FROM dirty_events"
)


@query("sink_split", SPLIT_SQL)
def sink_split(spark, folder):
    path = new_path(spark, "split")
    sinks.write_split(fx.dirty_events(spark, folder), RULES, path)
    return _both_sides(*sinks.read_split(spark, path))


@query("sink_split_csv", SPLIT_SQL)
def sink_split_csv(spark, folder):
    path = new_path(spark, "split")
    sinks.write_split(fx.dirty_events(spark, folder), RULES, path, "csv")
    return _both_sides(*sinks.read_split(spark, path, "csv"))


@query(
    "sink_schema",
    "SELECT * FROM (VALUES (0, 'event_id', 'bigint'), (1, 'ts', 'timestamp_ntz'),"
    " (2, 'user_id', 'bigint'), (3, 'event_type', 'string'), (4, 'value', 'double'))"
    " AS t(position, name, type)",
)
def sink_schema(spark, folder):
    path = new_path(spark, "schema")
    sinks.write_schema(fx.dirty_events(spark, folder), path)
    fields = F.from_json("value", "array<struct<name string, type string>>")
    rows = spark.read.text(path).select(F.posexplode(fields).alias("position", "field"))
    return rows.select("position", "field.name", "field.type")


@query(
    "load_stage",
    WITH + "SELECT * FROM dirty_events WHERE value IS NOT NULL",
)
def load_stage(spark, folder):
    name = f"sparkprep_final_{uuid.uuid4().hex}"
    clean = filters.drop_missing(fx.dirty_events(spark, folder), ["value"])
    sinks.load_result(clean, name, path=new_path(spark, "final"))
    try:
        sinks.load_result(clean.where("event_id < 0"), name)
    except ValueError:
        return spark.table(name)
    raise AssertionError("an empty result was loaded")


def _both_sides(clean: DataFrame, error: DataFrame) -> DataFrame:
    return clean.withColumn("is_error", F.lit(False)).unionByName(
        error.withColumn("is_error", F.lit(True))
    )


@query(
    "sink_sample_csv",
    "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders"
    " ORDER BY o_totalprice DESC, o_orderkey LIMIT 5",
)
def sink_sample_csv(spark, folder):
    path = new_path(spark, "sample")
    orders = table(spark, folder, "orders").select(
        (-F.col("o_totalprice")).alias("_order"), "o_orderkey", "o_totalprice", "o_orderpriority"
    )
    sinks.write_sample_csv(orders, path, order_by=["_order", "o_orderkey"])
    return readers.read_csv(spark, path).drop("_order")


# --- columns --------------------------------------------------------------


@query("drop_columns", "SELECT event_id, ts, user_id, event_type FROM events")
def drop_columns(spark, folder):
    events = table(spark, folder, "events")
    return projections.drop_columns(events, ["value", "props", "absent"])


@query("drop_column_if_null", WITH + "SELECT event_id, ts, user_id, event_type FROM dirty_events")
def drop_column_if_null(spark, folder):
    dropped = projections.drop_column_if_null(fx.dirty_events(spark, folder), "value")
    return projections.drop_column_if_null(dropped, "event_id")


@query(
    "rename_column",
    "SELECT c_custkey, c_name AS customer, c_nationkey, c_acctbal, c_mktsegment FROM customer",
)
def rename_column(spark, folder):
    renamed = projections.rename_column(table(spark, folder, "customer"), "c_name", "customer")
    return projections.rename_column(renamed, "absent", "x")


MIXED_NAMES = ("EventID", "UserName2Key", "event_type", "HTTPValue", "ts x")


def _mixed(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    return events.select("event_id", "user_id", "event_type", "value", "ts").toDF(*MIXED_NAMES)


def _renamed_sql(names: tuple[str, ...]) -> str:
    sources = ("event_id", "user_id", "event_type", "value", "ts")
    return f"SELECT {', '.join(f'{s} AS "{n}"' for s, n in zip(sources, names))} FROM events"


@query(
    "rename_lower",
    _renamed_sql(("eventid", "username2key", "event_type", "httpvalue", "ts x")),
)
def rename_lower(spark, folder):
    return projections.apply_convention(_mixed(spark, folder), "to_lowercase")


@query(
    "rename_upper",
    _renamed_sql(("EVENTID", "USERNAME2KEY", "event_type", "HTTPVALUE", "ts x")),
)
def rename_upper(spark, folder):
    return projections.apply_convention(
        _mixed(spark, folder), "to_uppercase", ["EventID", "UserName2Key", "HTTPValue", "absent"]
    )


@query(
    "rename_snake",
    _renamed_sql(("event_id", "user_name2_key", "event_type", "http_value", "ts x")),
)
def rename_snake(spark, folder):
    return projections.apply_convention(_mixed(spark, folder), "to_snake_case")


@query(
    "rename_camel",
    _renamed_sql(("eventId", "userName2Key", "eventType", "httpValue", "tsX")),
)
def rename_camel(spark, folder):
    return projections.apply_convention(_mixed(spark, folder), "to_camel_case")


@query("rename_trim", "SELECT r_regionkey, r_name FROM region")
def rename_trim(spark, folder):
    padded = table(spark, folder, "region").toDF(" r_regionkey ", "r_name  ")
    return projections.apply_convention(padded, "trim_spaces")


@query("transform_remove_column", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier")
def transform_remove_column(spark, folder):
    return steps.RemoveColumn(("s_name",))(table(spark, folder, "supplier"))


# --- filters --------------------------------------------------------------


@query(
    "dropna_any",
    WITH + "SELECT * FROM dirty_events"
    " WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND value IS NOT NULL",
)
def dropna_any(spark, folder):
    return filters.drop_missing(fx.dirty_events(spark, folder))


@query(
    "dropna_subset",
    WITH + "SELECT * FROM dirty_lineitem WHERE l_quantity IS NOT NULL AND l_returnflag IS NOT NULL",
)
def dropna_subset(spark, folder):
    lineitem = fx.dirty_lineitem(spark, folder)
    return filters.drop_missing(lineitem, ["l_quantity", "l_returnflag", "absent"])


@query(
    "dropna_all",
    WITH + "SELECT * FROM dirty_events WHERE NOT (event_type IS NULL AND value IS NULL)",
)
def dropna_all(spark, folder):
    return filters.drop_missing(fx.dirty_events(spark, folder), ["event_type", "value"], "all")


@query("filter_equals", "SELECT * FROM orders WHERE o_orderstatus = 'F'")
def filter_equals(spark, folder):
    return steps.FilterEquals.parse("o_orderstatus:F")(table(spark, folder, "orders"))


@query("filter_equals_number", "SELECT * FROM lineitem WHERE l_linenumber = 3")
def filter_equals_number(spark, folder):
    return filters.filter_equals(table(spark, folder, "lineitem"), "l_linenumber", "3")


@query(
    "has_nulls",
    WITH + "SELECT "
    + ", ".join(
        f"bool_or({c} IS NULL) AS {c}" for c in ("event_id", "ts", "user_id", "event_type", "value")
    )
    + " FROM dirty_events",
)
def has_nulls(spark, folder):
    return filters.has_nulls(fx.dirty_events(spark, folder))


# --- fills ----------------------------------------------------------------


def _rounded(df: DataFrame, key: str, column: str) -> DataFrame:
    return df.select(key, F.round(column, 6).alias(column))


@query(
    "fill_mean",
    WITH + "SELECT event_id, round(coalesce(value, m), 6) AS value FROM dirty_events"
    " CROSS JOIN (SELECT avg(value) AS m FROM dirty_events)",
)
def fill_mean(spark, folder):
    return _rounded(fill.fill_mean(fx.dirty_events(spark, folder), "value"), "event_id", "value")


@query(
    "fill_mean_integer",
    WITH + "SELECT event_id, round(coalesce(user_id, m), 6) AS user_id FROM dirty_events"
    " CROSS JOIN (SELECT avg(user_id) AS m FROM dirty_events)",
)
def fill_mean_integer(spark, folder):
    return _rounded(fill.fill_mean(fx.dirty_events(spark, folder), "user_id"), "event_id", "user_id")


@query(
    "fill_median",
    WITH + "SELECT event_id, round(coalesce(value, m), 6) AS value FROM dirty_events"
    " CROSS JOIN (SELECT median(value) AS m FROM dirty_events)",
)
def fill_median(spark, folder):
    return _rounded(fill.fill_median(fx.dirty_events(spark, folder), "value"), "event_id", "value")


@query(
    "fill_median_narrowing",
    WITH + "SELECT l_orderkey, l_linenumber, round(coalesce(l_extendedprice, m), 6)"
    " AS l_extendedprice FROM dirty_lineitem"
    " CROSS JOIN (SELECT median(l_extendedprice) AS m FROM dirty_lineitem)",
)
def fill_median_narrowing(spark, folder):
    filled = fill.fill_median(fx.dirty_lineitem(spark, folder), "l_extendedprice")
    return filled.select(
        "l_orderkey", "l_linenumber", F.round("l_extendedprice", 6).alias("l_extendedprice")
    )


@query(
    "fill_median_decimal",
    "WITH d AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE"
    " CAST(l_partkey AS HUGEINT) + 12345678901234560000::HUGEINT END AS v FROM lineitem),"
    " r AS (SELECT v, row_number() OVER (ORDER BY v) AS i, count(*) OVER () AS n FROM d"
    " WHERE v IS NOT NULL)"
    " SELECT l_orderkey, l_linenumber, CAST(coalesce(v, m) AS VARCHAR) AS v FROM d CROSS JOIN"
    " (SELECT (min(v) + max(v) + 1) // 2 AS m FROM r"
    " WHERE i = (n + 1) // 2 OR i = n // 2 + 1)",
)
def fill_median_decimal(spark, folder):
    """Values that a double cannot tell apart; a half is rounded to the type of the column."""
    values = table(spark, folder, "lineitem").selectExpr(
        "l_orderkey",
        "l_linenumber",
        "CASE WHEN l_partkey % 7 <> 0 THEN"
        " CAST(l_partkey + CAST(12345678901234560000 AS DECIMAL(20,0)) AS DECIMAL(20,0)) END AS v",
    )
    return fill.fill_median(values, "v").withColumn("v", F.col("v").cast("string"))


@query(
    "fill_medians",
    WITH + "SELECT l_orderkey, l_linenumber, round(coalesce(l_quantity, a), 6) AS l_quantity,"
    " round(coalesce(l_extendedprice, b), 6) AS l_extendedprice, near FROM"
    " (SELECT d.* EXCLUDE (near), CASE WHEN l_orderkey % 11 = 0 THEN m ELSE near END AS near FROM"
    " (SELECT *, CASE WHEN l_orderkey = 1 THEN 1.9 ELSE 1 + l_orderkey / 1099511627776.0 END AS near"
    " FROM dirty_lineitem) d CROSS JOIN (SELECT median(near) AS m FROM (SELECT CASE WHEN"
    " l_orderkey = 1 THEN 1.9 ELSE 1 + l_orderkey / 1099511627776.0 END AS near"
    " FROM dirty_lineitem WHERE l_orderkey % 11 <> 0)))"
    " CROSS JOIN (SELECT median(l_quantity) AS a, median(l_extendedprice) AS b FROM dirty_lineitem)",
)
def fill_medians(spark, folder):
    """Three medians in one plan, one of values that are all nearly alike but for one."""
    near = "CASE WHEN l_orderkey = 1 THEN 1.9D ELSE 1 + l_orderkey / 1099511627776D END"
    lineitem = fx.dirty_lineitem(spark, folder).withColumn(
        "near", F.expr(f"CASE WHEN l_orderkey % 11 <> 0 THEN {near} END")
    )
    plan = [steps.FillNulls(c, "fill_median") for c in ("l_quantity", "l_extendedprice", "near")]
    filled = cleaning.apply_steps(lineitem, plan)
    return filled.select(
        "l_orderkey",
        "l_linenumber",
        F.round("l_quantity", 6).alias("l_quantity"),
        F.round("l_extendedprice", 6).alias("l_extendedprice"),
        "near",
    )


@query(
    "fill_mode",
    WITH + "SELECT event_id, coalesce(event_type, m) AS event_type FROM dirty_events"
    " CROSS JOIN (SELECT event_type AS m FROM dirty_events WHERE event_type IS NOT NULL"
    " GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1)",
)
def fill_mode(spark, folder):
    return fill.fill_mode(fx.dirty_events(spark, folder), "event_type").select(
        "event_id", "event_type"
    )


@query(
    "fill_value_numeric",
    WITH + "SELECT event_id, coalesce(CAST(user_id AS DOUBLE), 0.5) AS user_id,"
    " coalesce(value, 0) AS value FROM dirty_events",
)
def fill_value_numeric(spark, folder):
    dirty = fx.dirty_events(spark, folder)
    widened = fill.fill_value(dirty, "user_id", fill.coerce_fill_value("0.5", T.LongType()))
    return fill.fill_value(widened, "value", 0).select("event_id", "user_id", "value")


@query(
    "fill_value_string",
    WITH + "SELECT event_id, CASE WHEN h THEN coalesce(nullif(event_type, ''), 'UNKNOWN')"
    " ELSE event_type END AS event_type FROM dirty_events"
    " CROSS JOIN (SELECT bool_or(event_type IS NULL) AS h FROM dirty_events)",
)
def fill_value_string(spark, folder):
    return fill.fill_value(fx.dirty_events(spark, folder), "event_type", "UNKNOWN").select(
        "event_id", "event_type"
    )


@query(
    "fill_strategies",
    WITH + "SELECT 'user_id' AS \"column\", count(*) - count(user_id) AS missing,"
    " 'fill_mean,fill_median,fill_specific' AS strategies, '0' AS default_value FROM dirty_events"
    " UNION ALL SELECT 'event_type', count(*) - count(event_type), 'fill_mode,fill_specific',"
    " 'UNKNOWN' FROM dirty_events"
    " UNION ALL SELECT 'value', count(*) - count(value), 'fill_mean,fill_median,fill_specific',"
    " '0' FROM dirty_events",
)
def fill_strategies(spark, folder):
    return profile.fill_strategies(fx.dirty_events(spark, folder))


# --- duplicates and profile -----------------------------------------------


@query("dedup_rows", WITH + "SELECT DISTINCT * FROM dup_events")
def dedup_rows(spark, folder):
    return remove_duplicates(fx.dup_events(spark, folder))


@query("dedup_documents", "SELECT DISTINCT text, lang, source, n_chars FROM documents")
def dedup_documents(spark, folder):
    return remove_duplicates(table(spark, folder, "documents").drop("doc_id"))


@query(
    "rows_removed",
    WITH + "SELECT (SELECT count(*) FROM dup_events) AS initial_rows,"
    " (SELECT count(*) FROM (SELECT DISTINCT * FROM dup_events)) AS final_rows,"
    " (SELECT count(*) FROM dup_events)"
    " - (SELECT count(*) FROM (SELECT DISTINCT * FROM dup_events)) AS rows_removed",
)
def rows_removed(spark, folder):
    report = cleaning.run_steps(fx.dup_events(spark, folder), [steps.RemoveDuplicates()])
    first, last = report.records[0], report.records[-1]
    return spark.createDataFrame(
        [(first.initial_rows, last.final_rows, report.rows_removed)],
        "initial_rows bigint, final_rows bigint, rows_removed bigint",
    )


@query("shape", 'SELECT count(*) AS "rows", CAST(11 AS BIGINT) AS "columns" FROM lineitem')
def shape(spark, folder):
    return profile.shape(table(spark, folder, "lineitem"))


def _profile_sql(column: str, numeric: bool, of: str = "dirty_events") -> str:
    stats = (
        f"round(avg({column}), 6) AS mean, round(median({column}), 6) AS median"
        if numeric
        else "CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS median"
    )
    return (
        f"SELECT '{column}' AS \"column\", count(*) - count({column}) AS missing, {stats},"
        f" (SELECT CAST({column} AS VARCHAR) FROM {of} WHERE {column} IS NOT NULL"
        f" GROUP BY {column} ORDER BY count(*) DESC, {column} LIMIT 1) AS mode FROM {of}"
    )


@query(
    "profile_columns",
    WITH
    + _profile_sql("user_id", True)
    + " UNION ALL "
    + _profile_sql("event_type", False)
    + " UNION ALL "
    + _profile_sql("value", True),
)
def profile_columns(spark, folder):
    return profile.profile_columns(
        fx.dirty_events(spark, folder), ["user_id", "event_type", "value"]
    )


LINEITEM_COLUMNS = {
    "l_orderkey": True,
    "l_partkey": True,
    "l_suppkey": True,
    "l_linenumber": True,
    "l_quantity": True,
    "l_extendedprice": True,
    "l_discount": True,
    "l_tax": True,
    "l_returnflag": False,
    "l_linestatus": False,
    "l_shipdate": False,
}


@query(
    "profile_lineitem",
    " UNION ALL ".join(_profile_sql(n, number, "lineitem") for n, number in LINEITEM_COLUMNS.items()),
)
def profile_lineitem(spark, folder):
    return profile.profile_columns(table(spark, folder, "lineitem"))


@query("preview_top5", "SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 5")
def preview_top5(spark, folder):
    return profile.preview(
        table(spark, folder, "lineitem"), order_by=["l_orderkey", "l_linenumber", "l_partkey"]
    )


@query(
    "schema_table",
    WITH
    + " UNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS position, '{n}' AS name, '{t}' AS type, '{f}' AS family,"
        f" count({n}) AS present FROM dirty_events"
        for i, (n, t, f) in enumerate(
            (
                ("event_id", "bigint", "int"),
                ("ts", "timestamp_ntz", "datetime"),
                ("user_id", "bigint", "int"),
                ("event_type", "string", "string"),
                ("value", "double", "float"),
            ),
            start=1,
        )
    ),
)
def schema_table(spark, folder):
    return profile.schema_table(fx.dirty_events(spark, folder))


# --- validation -----------------------------------------------------------

RULES = (NotNull("value"), NotNull("event_type"))


def _report_sql(rule: str, column: str, bad: str, of: str, table_ok: bool = True) -> str:
    failed = f"count(CASE WHEN {bad} THEN 1 END)"
    success = f"{failed} = 0" if table_ok else "FALSE"
    return (
        f"SELECT '{rule}' AS rule, '{column}' AS \"column\", {success} AS success,"
        f" count(*) AS element_count, {failed} AS unexpected_count,"
        f" round({failed} * 100.0 / count(*), 6) AS unexpected_percent FROM {of}"
    )


TYPE_SQL = {
    "int": f"NOT regexp_matches(raw_value, '{validate.INT_TEXT}')",
    "float": f"NOT regexp_matches(raw_value, '{validate.FLOAT_TEXT}')",
    "boolean": "lower(raw_flag) NOT IN ('true', 'false')",
    "datetime": f"raw_time IS NOT NULL AND NOT (regexp_matches(raw_time,"
    f" '{validate.DATETIME_TEXT}') AND try_cast(raw_time AS TIMESTAMP) IS NOT NULL)",
    "string": "FALSE",
}
TYPE_COLUMNS = {
    "int": "raw_value",
    "float": "raw_value",
    "boolean": "raw_flag",
    "datetime": "raw_time",
    "string": "raw_value",
}


def _type_query(kind: str) -> None:
    column = TYPE_COLUMNS[kind]

    @query(
        f"rule_type_{kind}",
        WITH + _report_sql(f"of_type({column}, {kind})", column, TYPE_SQL[kind], "raw_events"),
    )
    def rule_type(spark, folder):
        return validate.validation_report(fx.raw_events(spark, folder), [OfType(column, kind)])


for _kind in cols.TYPE_NAMES:
    _type_query(_kind)


@query(
    "rule_type_declared",
    WITH
    + _report_sql("of_type(value, float)", "value", "FALSE", "dirty_events")
    + " UNION ALL "
    + _report_sql("of_type(user_id, string)", "user_id", "FALSE", "dirty_events", False),
)
def rule_type_declared(spark, folder):
    rules = [OfType("value", "float"), OfType("user_id", "string")]
    return validate.validation_report(fx.dirty_events(spark, folder), rules)


@query(
    "rule_column_exists",
    _report_sql("column_exists(event_id)", "event_id", "FALSE", "events")
    + " UNION ALL "
    + _report_sql("column_exists(absent)", "absent", "FALSE", "events", False),
)
def rule_column_exists(spark, folder):
    rules = [ColumnExists("event_id"), ColumnExists("absent")]
    return validate.validation_report(table(spark, folder, "events"), rules)


@query(
    "rule_not_null",
    WITH + _report_sql("not_null(value)", "value", "value IS NULL", "dirty_events"),
)
def rule_not_null(spark, folder):
    return validate.validation_report(fx.dirty_events(spark, folder), [NotNull("value")])


SUITE = (
    NotNull("l_quantity"),
    NotNull("l_returnflag"),
    OfType("l_extendedprice", "float"),
    ColumnExists("l_comment"),
)
SUITE_SQL = (
    WITH
    + _report_sql("not_null(l_quantity)", "l_quantity", "l_quantity IS NULL", "dirty_lineitem")
    + " UNION ALL "
    + _report_sql("not_null(l_returnflag)", "l_returnflag", "l_returnflag IS NULL", "dirty_lineitem")
    + " UNION ALL "
    + _report_sql("of_type(l_extendedprice, float)", "l_extendedprice", "FALSE", "dirty_lineitem")
    + " UNION ALL "
    + _report_sql("column_exists(l_comment)", "l_comment", "FALSE", "dirty_lineitem", False)
)


@query("validation_report", SUITE_SQL)
def validation_report(spark, folder):
    return validate.validation_report(fx.dirty_lineitem(spark, folder), SUITE)


@query("suite_success", f"SELECT bool_and(success) AS success FROM ({SUITE_SQL})")
def suite_success(spark, folder):
    return validate.suite_success(
        validate.validation_report(fx.dirty_lineitem(spark, folder), SUITE)
    )


@query("suite_from_json", SUITE_SQL)
def suite_from_json(spark, folder):
    snake = json.loads(validate.suite_to_json(SUITE[:2]))["expectations"]
    camel = [
        {
            "expectation_type": "ExpectColumnValuesToBeOfType",
            "kwargs": {"column": "l_extendedprice"},
            "expected_type": "float",
        },
        {"expectation_type": "ExpectColumnToExist", "kwargs": {"column": "l_comment"}},
    ]
    suite = {"data_asset_type": "SparkDFDataset", "expectations": snake + camel}
    text = json.dumps(cleaning.envelope("validation", {"suite": suite}))
    return validate.validation_report(
        fx.dirty_lineitem(spark, folder), validate.suite_from_json(text)
    )


@query(
    "split_clean",
    WITH + "SELECT * FROM dirty_events WHERE value IS NOT NULL AND event_type IS NOT NULL",
)
def split_clean(spark, folder):
    return validate.split(fx.dirty_events(spark, folder), RULES)[0]


@query(
    "split_error",
    WITH + "SELECT * FROM dirty_events WHERE value IS NULL OR event_type IS NULL",
)
def split_error(spark, folder):
    return validate.split(fx.dirty_events(spark, folder), RULES)[1]


@query(
    "split_error_types",
    WITH + f"SELECT * FROM raw_events WHERE {TYPE_SQL['int']} OR {TYPE_SQL['datetime']}",
)
def split_error_types(spark, folder):
    rules = [OfType("raw_value", "int"), OfType("raw_time", "datetime")]
    return validate.split(fx.raw_events(spark, folder), rules)[1]


@query(
    "error_reasons",
    WITH + "SELECT 'not_null(value)' AS rule, count(*) AS rows FROM dirty_events"
    " WHERE value IS NULL UNION ALL SELECT 'not_null(event_type)', count(*) FROM dirty_events"
    " WHERE event_type IS NULL",
)
def error_reasons(spark, folder):
    return validate.error_reasons(fx.dirty_events(spark, folder), RULES)


@query(
    "unexpected_sample",
    WITH + "SELECT rule, event_id FROM ("
    "SELECT 'not_null(value)' AS rule, event_id, row_number() OVER (ORDER BY event_id) AS rn"
    " FROM dirty_events WHERE value IS NULL UNION ALL "
    "SELECT 'not_null(event_type)', event_id, row_number() OVER (ORDER BY event_id)"
    " FROM dirty_events WHERE event_type IS NULL) WHERE rn <= 20",
)
def unexpected_sample(spark, folder):
    sample = validate.unexpected_sample(fx.dirty_events(spark, folder), RULES, "event_id")
    return sample.select("rule", "event_id")


# --- step plans and lineage -----------------------------------------------

PLAN = (
    steps.FillNulls("value", "fill_median"),
    steps.FillNulls("event_type", "fill_mode"),
    steps.RemoveNulls("drop_rows_col", ("user_id",)),
    steps.DropColumns(("ts",)),
    steps.RenameColumns("to_uppercase", columns_to_transform="*"),
    steps.RemoveDuplicates(),
)


def _plan_sql(rows: str) -> str:
    """The result of ``PLAN`` on the events that ``rows`` selects."""
    return (
        WITH + f", taken AS ({rows}) "
        "SELECT DISTINCT event_id AS \"EVENT_ID\", user_id AS \"USER_ID\","
        " coalesce(event_type, t) AS \"EVENT_TYPE\", round(coalesce(value, m), 6) AS \"VALUE\""
        " FROM taken CROSS JOIN (SELECT median(value) AS m FROM taken)"
        " CROSS JOIN (SELECT event_type AS t FROM taken WHERE event_type IS NOT NULL"
        " GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1)"
        " WHERE user_id IS NOT NULL"
    )


PLAN_SQL = _plan_sql("SELECT * FROM dup_events")


def _rounded_value(df: DataFrame) -> DataFrame:
    return df.withColumn("VALUE", F.round("VALUE", 6))


@query("clean_steps", PLAN_SQL)
def clean_steps(spark, folder):
    return _rounded_value(cleaning.apply_steps(fx.dup_events(spark, folder), PLAN))


@query("steps_from_spec", PLAN_SQL)
def steps_from_spec(spark, folder):
    found = cleaning.steps_from_spec(cleaning.spec_from_steps(PLAN, "events"))
    return _rounded_value(cleaning.apply_steps(fx.dup_events(spark, folder), found))


@query("steps_from_params", PLAN_SQL)
def steps_from_params(spark, folder):
    found = [steps.step_from_typed_params(s.type, s.typed_params()) for s in PLAN]
    return _rounded_value(cleaning.apply_steps(fx.dup_events(spark, folder), found))


LINEITEM_PLAN = (
    steps.FillNulls("l_quantity", "fill_mean"),
    steps.FillNulls("l_extendedprice", "fill_specific", 0),
    steps.FillNulls("l_returnflag", "fill_mode"),
    steps.FilterEquals("l_linestatus", "O"),
    steps.RemoveColumn(("l_shipdate",)),
)


@query(
    "clean_steps_lineitem",
    WITH + "SELECT l_orderkey, l_linenumber, round(coalesce(l_quantity, m), 6) AS l_quantity,"
    " coalesce(l_extendedprice, 0) AS l_extendedprice, coalesce(l_returnflag, t) AS l_returnflag,"
    " l_linestatus FROM dirty_lineitem"
    " CROSS JOIN (SELECT avg(l_quantity) AS m FROM dirty_lineitem)"
    " CROSS JOIN (SELECT l_returnflag AS t FROM dirty_lineitem WHERE l_returnflag IS NOT NULL"
    " GROUP BY l_returnflag ORDER BY count(*) DESC, l_returnflag LIMIT 1)"
    " WHERE l_linestatus = 'O'",
)
def clean_steps_lineitem(spark, folder):
    cleaned = cleaning.apply_steps(fx.dirty_lineitem(spark, folder), LINEITEM_PLAN)
    return cleaned.withColumn("l_quantity", F.round("l_quantity", 6))


@query("job_from_spec", _plan_sql("SELECT * FROM dup_events WHERE value IS NOT NULL"))
def job_from_spec(spark, folder):
    target = f"sparkprep_job_{uuid.uuid4().hex}"
    spec = {
        "pipeline_name": "events",
        "source": {"table": _saved_table(spark, fx.dup_events(spark, folder), "job")},
        "validation_config": {"suite": json.loads(validate.suite_to_json(RULES[:1]))},
        "branch": "clean",
        "cleaning_config": {"cleaning_steps": steps.steps_to_dicts(PLAN)},
        "output_table": target,
        "output_path": new_path(spark, "job"),
    }
    job.run_job(spark, json.dumps(spec))
    return _rounded_value(spark.table(target))


@query("job_from_file_spec", JSON_SQL + " UNION ALL " + JSON_SQL + " UNION ALL " + JSON_SQL)
def job_from_file_spec(spark, folder):
    """Jobs that read CSV, JSON lines and a JSON array, by the name of the format only."""
    conversations = table(spark, folder, "conversations")
    csv, lines = new_path(spark, "csv"), new_path(spark, "json")
    sinks.write_csv(conversations, csv, multi_line=True)
    conversations.write.json(lines)
    schema = "conv_id bigint, turn bigint, role string, text string"
    sources = [
        {"path": csv, "format": "CSV", "multi_line": True, "schema": schema},
        {"path": lines, "format": "JSON", "schema": schema},
        {"path": _json_array(spark, folder), "format": "json", "schema": schema},
    ]
    loaded = []
    for source in sources:
        target = f"sparkprep_job_{uuid.uuid4().hex}"
        output = new_path(spark, "job")
        spec = {"source": source, "output_table": target, "output_path": output}
        job.run_job(spark, json.dumps(spec))
        loaded.append(spark.table(target))
    return reduce(DataFrame.unionByName, loaded)


REPORT_SQL = (
    "(SELECT count(*) FROM dup_events) AS a,"
    " (SELECT count(*) FROM dup_events WHERE user_id IS NOT NULL) AS k,"
    " (SELECT count(*) FROM (SELECT DISTINCT event_id, user_id, event_type, value"
    " FROM dup_events WHERE user_id IS NOT NULL)) AS d"
)


@query(
    "step_report",
    WITH + "SELECT CAST(seq AS BIGINT) AS seq, initial_rows, CAST(initial_columns AS BIGINT)"
    " AS initial_columns, final_rows, CAST(final_columns AS BIGINT) AS final_columns FROM ("
    + " UNION ALL ".join(
        f"SELECT {seq} AS seq, {i} AS initial_rows, {ic} AS initial_columns, {f} AS final_rows,"
        f" {fc} AS final_columns FROM (SELECT {REPORT_SQL})"
        for seq, i, ic, f, fc in (
            (1, "a", 5, "a", 5),
            (2, "a", 5, "a", 5),
            (3, "a", 5, "k", 5),
            (4, "k", 5, "k", 4),
            (5, "k", 4, "k", 4),
            (6, "k", 4, "d", 4),
        )
    )
    + ")",
)
def step_report(spark, folder):
    report = cleaning.run_steps(fx.dup_events(spark, folder), PLAN).to_frame(spark)
    return report.select("seq", "initial_rows", "initial_columns", "final_rows", "final_columns")


@query(
    "drop_columns_if_null",
    WITH + "SELECT event_id, ts FROM dirty_events",
)
def drop_columns_if_null(spark, folder):
    names = ("user_id", "ts", "event_type", "value", "absent")
    plan = [steps.RemoveNulls("drop_column", column_to_drop=n) for n in names]
    return cleaning.apply_steps(fx.dirty_events(spark, folder), plan)


@query(
    "clean_error_branch",
    WITH + "SELECT event_id, user_id, coalesce(nullif(event_type, ''), 'UNKNOWN') AS event_type,"
    " coalesce(value, 0) AS value FROM dirty_events WHERE value IS NULL OR event_type IS NULL",
)
def clean_error_branch(spark, folder):
    branches = cleaning.Branches(fx.dirty_events(spark, folder), RULES)
    plan = [
        steps.FillNulls("event_type", "fill_specific", "UNKNOWN"),
        steps.FillNulls("value", "fill_specific", 0),
        steps.DropColumns(("ts",)),
    ]
    return branches.cleaned("error", plan)


@query(
    "repaired_union",
    WITH
    + "SELECT event_id, user_id, CASE WHEN value IS NULL OR event_type IS NULL"
    " THEN coalesce(nullif(event_type, ''), 'UNKNOWN') ELSE event_type END AS event_type,"
    " round(coalesce(value, m), 6) AS value, FALSE AS is_error FROM dirty_events"
    " CROSS JOIN (SELECT avg(value) AS m FROM dirty_events WHERE event_id % 3 <> 0)"
    " WHERE event_id % 3 <> 0 UNION ALL SELECT event_id, user_id, CASE WHEN value IS NULL OR event_type IS NULL"
    " THEN coalesce(nullif(event_type, ''), 'UNKNOWN') ELSE event_type END, round(value, 6), value IS NULL"
    " FROM dirty_events WHERE event_id % 3 = 0",
)
def repaired_union(spark, folder):
    """Error rows that are repaired join the clean ones, the others stay errors.

    Types are filled in all of them, values in two thirds.
    """
    dirty = fx.dirty_events(spark, folder).select("event_id", "user_id", "event_type", "value")
    fill_type = steps.FillNulls("event_type", "fill_specific", "UNKNOWN")
    fill_value = steps.FillNulls("value", "fill_mean")
    parts = [
        cleaning.Branches(dirty.where(rows), RULES).repaired(plan)
        for rows, plan in (
            ("event_id % 3 <> 0", [fill_type, fill_value]),
            ("event_id % 3 = 0", [fill_type]),
        )
    ]
    both = reduce(DataFrame.unionByName, (_both_sides(*part) for part in parts))
    return both.withColumn("value", F.round("value", 6))


SKIPPING = (
    steps.FillNulls("absent", "fill_mean"),
    steps.FillNulls("event_type", "fill_median"),
    steps.FillNulls("event_id", "fill_mode"),
    steps.FillNulls("user_id", "fill_specific"),
    steps.RemoveNulls("drop_rows_col", ("absent",)),
    steps.RemoveNulls("drop_column", column_to_drop="event_id"),
    steps.RenameColumns("specific_rename", "absent", "other"),
    steps.FillNulls("value", "fill_mean"),
    steps.RemoveNulls("drop_rows_col", ("user_id",)),
)


@query(
    "step_report_reasons",
    WITH + "SELECT CAST(seq AS BIGINT) AS seq, status, reason, CASE WHEN seq = 9 THEN k ELSE a END AS final_rows,"
    " CASE WHEN seq = 8 THEN m END AS filled FROM (VALUES"
    " (1, 'skipped', 'Column ''absent'' not found.'),"
    " (2, 'skipped', 'Cannot fill median for non-numeric column ''event_type''.'),"
    " (3, 'skipped', 'Column ''event_id'' has no null values.'),"
    " (4, 'skipped', 'Fill value not provided for specific fill strategy.'),"
    " (5, 'skipped', 'No valid columns for drop_rows_col.'),"
    " (6, 'skipped', 'Column ''event_id'' has no nulls.'),"
    " (7, 'skipped', 'Column ''absent'' not found for specific rename.'),"
    " (8, 'applied', NULL), (9, 'applied', NULL)) AS t(seq, status, reason)"
    " CROSS JOIN (SELECT count(*) AS a, count(user_id) AS k, CAST(count(*) - count(value) AS VARCHAR) AS m"
    " FROM dirty_events)",
)
def step_report_reasons(spark, folder):
    """Steps that have nothing to do, each for its reason, among two that have."""
    report = cleaning.run_steps(fx.dirty_events(spark, folder), SKIPPING).to_frame(spark)
    return report.select("seq", "status", "reason", "final_rows", F.col("details")["filled"].alias("filled"))


@query(
    "suite_from_dict",
    WITH + "SELECT 'not_null(value)' AS rule, count(*) - count(value) AS unexpected_count"
    " FROM dirty_events UNION ALL SELECT 'not_null(event_type)', count(*) - count(event_type)"
    " FROM dirty_events UNION ALL SELECT 'column_exists(absent)', 0",
)
def suite_from_dict(spark, folder):
    """Rules given as a mapping; the one on a column that is not there is left out."""
    dirty = fx.dirty_events(spark, folder)
    spec = {
        "ExpectColumnValuesToNotBeNull": ["value", "event_type", "actions.video_view"],
        "expect_column_to_exist": "absent",
    }
    report = validate.validation_report(dirty, validate.suite_for(dirty, spec))
    return report.select("rule", "unexpected_count")


@query(
    "custom_step",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000",
)
def custom_step(spark, folder):
    steps.register_function(
        "at_least", lambda df, column, least: df.where(cols.qcol(column) >= F.lit(least))
    )
    plan = cleaning.steps_from_spec(
        [
            {"type": "at_least", "column": "o_totalprice", "least": 100000},
            {
                "type": "drop_columns",
                "columns_to_drop": [
                    "o_custkey",
                    "o_orderstatus",
                    "o_orderdate",
                    "o_orderpriority",
                ],
            },
        ]
    )
    return cleaning.apply_steps(table(spark, folder, "orders"), plan)


@query(
    "custom_rule",
    WITH + "SELECT 'at_least_10(value)' AS rule, count(*) AS rows FROM dirty_events WHERE value < 10",
)
def custom_rule(spark, folder):
    rule = validate.RowRule("value", "at_least_10(value)", lambda df: F.col("value") < 10)
    return validate.error_reasons(fx.dirty_events(spark, folder), [rule])


@query(
    "lineage_log",
    WITH + "SELECT CAST(seq AS INTEGER) AS seq, '(' || i || ', ' || ic || ')' AS initial_shape,"
    " '(' || f || ', ' || fc || ')' AS final_shape FROM ("
    + " UNION ALL ".join(
        f"SELECT {seq} AS seq, {i} AS i, {ic} AS ic, {f} AS f, {fc} AS fc"
        f" FROM (SELECT {REPORT_SQL})"
        for seq, i, ic, f, fc in (
            (0, "a", 5, "a", 5),
            (1, "a", 5, "a", 5),
            (2, "a", 5, "k", 5),
            (3, "k", 5, "k", 4),
            (4, "k", 4, "k", 4),
            (5, "k", 4, "d", 4),
        )
    )
    + ")",
)
def lineage_log(spark, folder):
    path, run = new_path(spark, "lineage"), uuid.uuid4().hex
    report = cleaning.run_steps(fx.dup_events(spark, folder), PLAN)
    entries = lineage.report_entries(report)
    lineage.append(spark, path, run, entries[:2])
    lineage.append(spark, path, run, entries[2:])
    log = lineage.read_log(spark, path).where(F.col("run_id") == run)
    return log.select("seq", "details.initial_shape", "details.final_shape")


@query(
    "lineage_concurrent",
    "SELECT count(*) AS entries, count(*) AS numbers, CAST(0 AS INTEGER) AS first,"
    " CAST(count(*) - 1 AS INTEGER) AS last, count(DISTINCT n_name) AS names FROM nation",
)
def lineage_concurrent(spark, folder):
    """Two writers of one run, each adding the nations that are its own, a few at a time."""
    path = new_path(spark, "lineage")
    names = [r.n_name for r in table(spark, folder, "nation").select("n_name").collect()]

    def write(mine: list[str]) -> None:
        for start in range(0, len(mine), 3):
            lineage.append(spark, path, "shared", [(n, {}) for n in mine[start : start + 3]])

    with ThreadPoolExecutor(2) as pool:
        list(pool.map(write, (names[::2], names[1::2])))
    return lineage.read_run(spark, path, "shared").agg(
        F.count("seq").alias("entries"),
        F.countDistinct("seq").alias("numbers"),
        F.min("seq").alias("first"),
        F.max("seq").alias("last"),
        F.countDistinct("name").alias("names"),
    )


@query(
    "lineage_edges",
    "SELECT * FROM (SELECT conv_id, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn)"
    " AS previous, turn AS \"current\" FROM conversations) WHERE previous IS NOT NULL",
)
def lineage_edges(spark, folder):
    return lineage.edges(table(spark, folder, "conversations"), "conv_id", "turn")


@query(
    "lineage_edges_sparse",
    "SELECT conv_id, previous * 1000000 AS previous, \"current\" * 1000000 AS \"current\" FROM"
    " (SELECT conv_id, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous,"
    " turn AS \"current\" FROM conversations) WHERE previous IS NOT NULL",
)
def lineage_edges_sparse(spark, folder):
    log = table(spark, folder, "conversations").withColumn("turn", F.col("turn") * 1_000_000)
    return lineage.edges(log, "conv_id", "turn")


@query(
    "lineage_labels",
    "SELECT conv_id, turn, 'Step ' || CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn)"
    " AS VARCHAR) || ': ' || role || chr(10) || '(' || CASE WHEN turn % 2 = 0 THEN 'text: '"
    " || text || ', ' ELSE '' END || 'turn: ' || CAST(turn AS VARCHAR) || ')' AS label"
    " FROM conversations",
)
def lineage_labels(spark, folder):
    log = table(spark, folder, "conversations").withColumn(
        "details",
        F.create_map(
            F.lit("text"),
            F.when(F.col("turn") % 2 == 0, F.col("text")),
            F.lit("turn"),
            F.col("turn").cast("string"),
            F.lit("note"),
            F.lit("None"),
        ),
    )
    return lineage.labels(log, "conv_id", "turn", "role")
