"""Reading files and tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.functions.columns import family, normalize_na, qcol
from sparkprep.functions.naming import check_names, distinct_header
from sparkprep.operators.validate import reads_as
from sparkprep.sources.catalog import list_files

DEFAULT_FORMAT = "parquet"

# Types tried for a text column, narrowest first.
_INFERRED = (("int", "bigint"), ("float", "double"), ("boolean", "boolean"))


def read_csv(
    spark: SparkSession,
    path: str,
    header: bool = True,
    delimiter: str = ",",
    schema: T.StructType | None = None,
    na: bool = True,
    infer: bool = True,
    multi_line: bool = False,
) -> DataFrame:
    """Read delimited text, every row and cell of it.

    Columns are named by the header, or "0", "1", ... without one; repeated
    header cells are numbered. Cells are read as text, the missing-value texts
    become null (``na``), and then every column is cast: to ``schema`` if one
    is given, which needs no extra pass, or else to the narrowest type that
    all its values have (``infer``), which takes one aggregate over the file.
    ``multi_line`` allows line breaks inside quotes; such files are not split.

    A row with more cells than columns is an error when it is read; one with
    fewer has nulls. All files of a folder must have the same header: the scan itself
    compares each file's with that of the first, cell by cell (so quotes do not matter),
    for the columns that are read.
    (Only where cells of the header are empty, repeated or the same but for case, is it
    compared as text, in one extra pass.)
    """
    options = {"sep": delimiter, "quote": '"', "escape": '"', "multiLine": str(multi_line)}
    first = spark.read.options(**options).csv(path, header=False).limit(1).first()
    if first is None:
        raise ValueError(f"no rows in {path}")
    names = distinct_header(list(first)) if header else [str(i) for i in range(len(first))]
    # Whether the scan can look for these names in the files.
    plain = header and names == list(first) and len({n.lower() for n in names}) == len(names)
    if header and not plain:
        _check_same_header(spark, path)
    wanted = names if schema is None else schema.names
    if len(wanted) != len(names):
        raise ValueError(f"the schema has {len(wanted)} columns and the file has {len(names)}")
    check_names(wanted)
    placed = names if plain else [f"c{i}" for i in range(len(names))]
    bad = "_bad"
    while bad in {n.lower() for n in placed}:
        bad += "_"
    text = T.StructType([T.StructField(n, T.StringType()) for n in [*placed, bad]])
    reader = spark.read.schema(text).options(**options, columnNameOfCorruptRecord=bad)
    df = reader.option("enforceSchema", not plain).csv(path, header=header)
    df = df.where(_no_cell_beyond(path, placed[0], bad, len(names), options)).drop(bad)
    if na:
        df = normalize_na(df)
    if schema is not None:
        return cast_to(df, schema)
    try:
        df = infer_types(df) if infer else df
    except Py4JJavaError as error:
        if "CSV header does not conform" not in str(error.java_exception.getCause()):
            raise
        raise ValueError(f"files in {path} have different headers") from error
    return df if placed == names else df.toDF(*names)


def _no_cell_beyond(path: str, first: str, bad: str, n: int, options: Mapping[str, str]) -> Column:
    """Always true; fails at a row with more than ``n`` cells.

    Spark keeps the text of rows with more or fewer cells than there are columns;
    read again with one column more, those with more have something in it.
    """
    more = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(n + 1)])
    again = {k: v for k, v in options.items() if k != "multiLine"}
    cell = F.from_csv(qcol(bad), more.simpleString()[len("struct<") : -1].replace(":", " "), again)[f"c{n}"]
    # (A column of the row itself has to be looked at along with its text.)
    told = F.concat(F.lit(f"a row of {path} has more than {n} cells, from "), F.coalesce(qcol(first), F.lit("")))
    beyond = F.raise_error(told).cast("boolean")
    return F.coalesce(F.when(qcol(bad).isNotNull() & cell.isNotNull(), beyond), F.lit(True))


def _first_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line): the first line of each file that is not blank.

    Only the first block of a file is looked at, which one task reads in order.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.trim("value").alias("line"),
    )
    found = lines.where("start = 0 AND line <> ''").groupBy("file")
    return found.agg(F.first("line").alias("line"))


def _check_same_header(spark: SparkSession, path: str) -> None:
    if list_files(spark, path).limit(2).count() < 2:
        return
    headers = _first_lines(spark, path).select("line").distinct().limit(2).collect()
    if len(headers) > 1:
        raise ValueError(f"files in {path} have different headers: {headers[0].line!r} and others")


def cast_to(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast by position. In ANSI mode, Spark's default, a text that is no value
    of its type is an error."""
    return df.select(
        [qcol(n).cast(f.dataType).alias(f.name) for n, f in zip(df.columns, schema.fields)]
    )


def infer_types(df: DataFrame) -> DataFrame:
    """Cast text columns to the narrowest type that fits all their values.

    One aggregate over the text columns; only its one row reaches the driver.
    A column without values stays text, as do dates.
    """
    names = [f.name for f in df.schema.fields if family(f.dataType) == "string"]
    if not names:
        return df
    fits = [
        F.bool_and(
            F.when(
                qcol(n).isNotNull(),
                reads_as(qcol(n), kind) & qcol(n).try_cast(dtype).isNotNull(),
            )
        ).alias(f"{dtype}_{i}")
        for i, n in enumerate(names)
        for kind, dtype in _INFERRED
    ]
    found = df.agg(*fits).first()
    chosen = {
        n: next((dtype for _, dtype in _INFERRED if found[f"{dtype}_{i}"]), "string")
        for i, n in enumerate(names)
    }
    return df.select(
        [qcol(n).cast(chosen[n]).alias(n) if n in chosen else qcol(n) for n in df.columns]
    )


def read_json(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    lines: bool | None = None,
) -> DataFrame:
    """Read an array of records, or with ``lines`` one record per line.

    Without ``lines`` the first file says which it is, by its first characters.
    That the others are alike is seen by the scan for records per line: a line that
    is no record is an error then (ahead of the scan if there is no schema). For
    arrays it takes a pass over the files, each of which one task parses anyway;
    large inputs should be lines, which are split. A single record spread over lines
    has to be asked for by ``lines=False``.
    """
    if lines is not None:
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.json(path, multiLine=not lines)
    if not _has_records_per_line(spark, path):
        return read_json(spark, path, schema, lines=False)
    bad = "_no_record"
    reader = spark.read.option("columnNameOfCorruptRecord", bad)
    if schema is None:
        df = reader.json(path)
        if bad in df.columns:
            raise ValueError(NEITHER.format(path))
        return df
    if bad in schema.names:
        raise ValueError(f"a column is called {bad}")
    df = reader.schema(T.StructType([*schema.fields, T.StructField(bad, T.StringType())])).json(path)
    # (A column of the record itself has to be looked at along with its text.)
    first = F.coalesce(qcol(schema.names[0]).isNull(), F.lit(True)).cast("string")
    told = F.raise_error(F.concat(F.lit(f"{NEITHER.format(path)}: "), qcol(bad), F.lit(" "), first))
    fine = F.coalesce(F.when(qcol(bad).isNotNull(), told.cast("boolean")), F.lit(True))
    return df.where(fine).drop(bad)


NEITHER = "{} is neither all arrays nor all records per line; say which with 'lines'"


def _has_records_per_line(spark: SparkSession, path: str) -> bool:
    line = F.col("line")
    whole = F.try_parse_json(line).isNotNull()
    form = (
        F.when(line.startswith("["), "array")
        .when(line.startswith("{") & whole, "lines")
        .otherwise("neither")
    )
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")
    first = lines.limit(1).select(form.alias("form")).first()
    forms = {first.form} if first else {"lines"}
    if forms == {"array"}:
        found = _first_lines(spark, path).select(form.alias("form")).distinct().collect()
        forms = {r.form for r in found}
    if len(forms) > 1 or "neither" in forms:
        raise ValueError(NEITHER.format(path))
    return forms != {"array"}


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_path(spark: SparkSession, path: str, fmt: str = DEFAULT_FORMAT, **options: str) -> DataFrame:
    """Read a table by its path, on any file system Spark is set up for."""
    return spark.read.format(fmt).options(**options).load(path)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """Read a catalog table, ``db.table`` or ``table``."""
    return spark.table(name)


def read_sql(spark: SparkSession, name: str) -> DataFrame:
    """``SELECT *`` from a table whose name is passed as a parameter, not pasted."""
    return spark.sql("SELECT * FROM IDENTIFIER(:name)", args={"name": name})


FileReader = Callable[[SparkSession, str, Mapping[str, object]], DataFrame]

def _csv_file(spark: SparkSession, path: str, options: Mapping[str, object]) -> DataFrame:
    schema = options.get("schema")
    return read_csv(
        spark,
        path,
        header=bool(options.get("header", True)),
        delimiter=str(options.get("delimiter", ",")),
        schema=T.StructType.fromDDL(str(schema)) if schema else None,
        multi_line=bool(options.get("multi_line", False)),
    )


def _json_file(spark: SparkSession, path: str, options: Mapping[str, object]) -> DataFrame:
    schema, lines = options.get("schema"), options.get("lines")
    return read_json(
        spark,
        path,
        schema=T.StructType.fromDDL(str(schema)) if schema else None,
        lines=None if lines is None else bool(lines),
    )


FILE_FORMATS: dict[str, FileReader] = {
    "CSV": _csv_file,
    "JSON": _json_file,
    "PARQUET": lambda spark, path, options: read_parquet(spark, path),
}


def register_format(name: str, reader: FileReader) -> None:
    """Make ``reader(spark, path, options)`` usable as a file format."""
    FILE_FORMATS[name.upper()] = reader


def read_file(spark: SparkSession, path: str, options: Mapping[str, object]) -> DataFrame:
    """Read a file by its format options.

    ``format``; for CSV ``header``, ``delimiter``, ``multi_line``; for JSON ``lines``;
    for both ``schema``, as DDL text, which saves the pass that infers types.
    """
    name = str(options.get("format", "CSV")).upper()
    if name not in FILE_FORMATS:
        raise ValueError(f"unsupported file format {options.get('format')!r}")
    return FILE_FORMATS[name](spark, path, options)
