"""Writing results."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.functions.columns import qcol
from sparkprep.operators.profile import PREVIEW_ROWS, preview, schema_list
from sparkprep.operators.validate import Rule, any_failure
from sparkprep.sources.catalog import table_path
from sparkprep.sources.readers import DEFAULT_FORMAT, read_file
from sparkprep.sources.replace import replace_by, replace_table, table_info

IS_ERROR = "_is_error"


def write_table(
    df: DataFrame,
    name: str,
    fmt: str = DEFAULT_FORMAT,
    mode: str = "overwrite",
    path: str | None = None,
    partition_by: Sequence[str] = (),
    options: Mapping[str, str] | None = None,
) -> None:
    """Save as a catalog table; with ``path`` the files go there.

    To overwrite is to define the table anew. A frame that reads the files which
    would go, those of the table as it is or of ``path``, is refused;
    ``overwrite_source_table`` takes it. Text tables read back what was written,
    see ``format_options``; the options are kept with the table.
    """
    if not name:
        raise ValueError("a table name is needed")
    spark = df.sparkSession
    if mode == "overwrite":
        for target in filter(None, (path, existing_location(spark, name))):
            check_apart(spark, source_paths(df), target)
    writer = lossless(df, fmt, options).write.format(fmt).mode(mode)
    writer = writer.options(**format_options(fmt, options))
    if path:
        writer = writer.option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(name)


def existing_location(spark: SparkSession, name: str) -> str | None:
    """Where a table's files are, if there is such a table."""
    return table_path(spark, name) if spark.catalog.tableExists(name) else None


def output_location(spark: SparkSession, name: str) -> str | None:
    """Where a table's files are, or would be if it were made."""
    if spark.catalog.tableExists(name):
        return table_path(spark, name)
    state = spark._jsparkSession.sessionState()
    return state.catalog().defaultTablePath(state.sqlParser().parseTableIdentifier(name)).toString()


def source_paths(df: DataFrame) -> list[str]:
    """The root paths of the files that a frame reads."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    found = []
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        try:
            roots = leaf.relation().location().rootPaths()
        except (AttributeError, TypeError, Py4JError):
            continue
        found += [roots.apply(k).toString() for k in range(roots.size())]
    return found


def check_apart(spark: SparkSession, sources: Sequence[str], target: str) -> None:
    """Refuse a target that is a source, or is inside one, or has one inside it.

    Overwriting it would delete what is still to be read.
    """
    configuration = spark._jsc.hadoopConfiguration()

    def qualified(path: str) -> str:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(configuration).makeQualified(hadoop).toString().rstrip("/")

    there = qualified(target)
    for source in sources:
        here = qualified(source)
        if f"{here}/".startswith(f"{there}/") or f"{there}/".startswith(f"{here}/"):
            raise ValueError(f"{target} cannot be written while {source} is read")


def overwrite_source_table(df: DataFrame, name: str) -> None:
    """Overwrite a table with a result that may be computed from it.

    The table keeps its place, format, options, partitioning and properties; see
    ``replace.replace_table``.
    """
    info = table_info(df.sparkSession, name)
    replace_table(lossless(df, info.provider, info.options), name)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete an intermediate result whose last reader is done."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def check_result(df: DataFrame) -> None:
    """Refuse a result without rows."""
    if df.isEmpty():
        raise ValueError("there is no data to load")


def load_result(
    df: DataFrame,
    name: str,
    fmt: str = DEFAULT_FORMAT,
    path: str | None = None,
    options: Mapping[str, str] | None = None,
) -> None:
    """Save the final result, which must have rows."""
    if not name:
        raise ValueError("an output table name is needed")
    check_result(df)
    write_table(df, name, fmt, path=path, options=options)


def load_file_to_table(
    spark: SparkSession,
    file: str,
    name: str,
    options: Mapping[str, object],
    fmt: str = DEFAULT_FORMAT,
    path: str | None = None,
    table_options: Mapping[str, str] | None = None,
) -> None:
    """Turn a CSV, JSON or Parquet file into a table, replacing it.

    ``options`` say how the file is read, ``table_options`` how the table is written.
    """
    write_table(read_file(spark, file, options), name, fmt, path=path, options=table_options)


# Where ``write_split`` leaves the schema; readers skip names with a leading _.
SPLIT_SCHEMA = "_schema"
# Times keep their microseconds.
CSV_OPTIONS = {
    "header": "true",
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


# What stands for null in CSV; no text may be it. Empty texts are quoted.
NULL_CELL = "\\N"


def format_options(fmt: str, options: Mapping[str, str] | None = None) -> dict[str, str]:
    """How a format is written and read so that rows come back as they were.

    CSV has a header, keeps spaces and microseconds and tells empty texts from
    nulls. Text with line breaks needs ``multiLine`` among the options.
    """
    # Quoted, a text of spaces is not taken for a blank line.
    own = {**CSV_OPTIONS, "nullValue": NULL_CELL, "quoteAll": "true"} if fmt.lower() == "csv" else {}
    return {**own, **(options or {})}


def lossless(df: DataFrame, fmt: str, options: Mapping[str, str] | None = None) -> DataFrame:
    """The frame; writing it fails at a text that the format could not give back."""
    if fmt.lower() != "csv":
        return df
    given = {k.lower(): str(v) for k, v in format_options(fmt, options).items()}
    broken = given.get("multiline", "").lower() != "true"
    null = F.lit(given["nullvalue"])

    def checked(field: T.StructField) -> Column:
        column = qcol(field.name)
        if not isinstance(field.dataType, T.StringType):
            return column
        named = f"{field.name} has a"
        is_null = F.raise_error(F.lit(f"{named} text that stands for null")).cast("string")
        out = F.when(column == null, is_null)
        if broken:
            told = F.raise_error(F.lit(f"{named} line break; write it with multiLine"))
            out = out.when(column.rlike("[\r\n]"), told.cast("string"))
        return out.otherwise(column).alias(field.name)

    return df.select([checked(f) for f in df.schema.fields])


def write_split(
    df: DataFrame,
    rules: Sequence[Rule],
    path: str,
    fmt: str = DEFAULT_FORMAT,
    options: Mapping[str, str] | None = None,
    replace: bool = False,
) -> None:
    """Write clean and error rows in one pass, as two partitions of one folder.

    CSV gets a header. The schema is kept beside the rows, so that a side
    without rows, or all of it, can be read back. A folder that is there already
    is an error, or with ``replace`` gives way to the new one once that is written.
    """
    if IS_ERROR in {c.lower() for c in df.columns}:
        raise ValueError(f"a column is called {IS_ERROR}")
    marked = lossless(df.withColumn(IS_ERROR, any_failure(df, rules)), fmt, options)
    writer = marked.write.format(fmt).options(**format_options(fmt, options))
    schema = df.sparkSession.createDataFrame([(df.schema.json(),)], "value string")

    def write(folder: str) -> None:
        writer.partitionBy(IS_ERROR).save(folder)
        schema.coalesce(1).write.text(f"{folder}/{SPLIT_SCHEMA}")

    if replace:
        replace_by(df.sparkSession, path, write)
    else:
        write(path)


def read_split(
    spark: SparkSession,
    path: str,
    fmt: str = DEFAULT_FORMAT,
    options: Mapping[str, str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The (clean, error) rows written by ``write_split``, or by a stream."""
    reader = spark.read.format(fmt).options(**format_options(fmt, options))
    try:
        text = spark.read.text(f"{path}/{SPLIT_SCHEMA}").first()
    except AnalysisException:
        text = None
    if text:
        schema = T.StructType.fromJson(json.loads(text.value))
        reader = reader.schema(T.StructType([*schema.fields, T.StructField(IS_ERROR, T.StringType())]))
    both = reader.load(path)
    flag = F.col(IS_ERROR).cast("boolean")
    return both.where(~flag).drop(IS_ERROR), both.where(flag).drop(IS_ERROR)


def write_schema(df: DataFrame, path: str) -> None:
    """Export the schema as a JSON list of names and types; no data is read."""
    text = json.dumps(schema_list(df))
    frame = df.sparkSession.createDataFrame([(text,)], "value string")
    frame.coalesce(1).write.mode("overwrite").text(path)


def write_sample_csv(
    df: DataFrame, path: str, rows: int = PREVIEW_ROWS, order_by: Sequence[str] = ()
) -> None:
    """Export the first rows as CSV with a header."""
    write_csv(preview(df, rows, order_by).coalesce(1), path)


def without_line_breaks(df: DataFrame) -> DataFrame:
    """The frame; writing it fails at a text with a line break."""

    def checked(field: T.StructField) -> Column:
        column = qcol(field.name)
        if not isinstance(field.dataType, T.StringType):
            return column
        told = F.raise_error(F.lit(f"{field.name} has a line break; write it with multi_line"))
        return F.when(column.rlike("[\r\n]"), told.cast("string")).otherwise(column).alias(field.name)

    return df.select([checked(f) for f in df.schema.fields])


def write_csv(
    df: DataFrame,
    path: str,
    header: bool = True,
    delimiter: str = ",",
    multi_line: bool = False,
) -> None:
    """Write delimited text that ``read_csv`` reads back unchanged.

    Text with line breaks is refused unless ``multi_line`` is given, as it is to
    be for reading.
    """
    writer = (df if multi_line else without_line_breaks(df)).write.mode("overwrite")
    writer.options(**{**CSV_OPTIONS, "header": str(header), "sep": delimiter}).csv(path)
