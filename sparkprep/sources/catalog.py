"""What there is to read: tables and files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """(name, temporary) for each table and view."""
    rows = [(t.name, t.isTemporary) for t in spark.catalog.listTables(database)]
    return spark.createDataFrame(rows, "name string, temporary boolean")


def table_sizes(spark: SparkSession, names: list[str]) -> DataFrame:
    """(name, rows, columns) of tables; Parquet counts come from file footers."""
    counts = [
        spark.table(n).agg(
            F.lit(n).alias("name"),
            F.count(F.lit(1)).alias("rows"),
            F.lit(len(spark.table(n).columns)).cast("bigint").alias("columns"),
        )
        for n in names
    ]
    return reduce(DataFrame.unionByName, counts)


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, file_name, length, modified) of the files in a folder.

    Contents are not read. Folders and ``.crc`` files are left out.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .load(folder)
        .select(
            "path",
            F.element_at(F.split("path", "/"), -1).alias("file_name"),
            "length",
            F.col("modificationTime").alias("modified"),
        )
    )
    return files.where(~F.col("file_name").endswith(".crc"))


def table_path(spark: SparkSession, name: str) -> str | None:
    """Where a table's files are; None for a view."""
    described = spark.sql("DESCRIBE TABLE EXTENDED IDENTIFIER(:name)", args={"name": name})
    row = described.where("col_name = 'Location'").first()
    return row.data_type if row else None
