"""Small helpers that the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkprep.functions.columns import qcol
from sparkprep.session import new_path

# Bytes that separate words: space, and tab to carriage return. ``bytes.split``
# without arguments splits at exactly these.
WORD = r"[^\x20\x09-\x0D]+"


def saved(df: DataFrame, label: str) -> DataFrame:
    """The frame written to the shared folder and read back; cuts the lineage."""
    path = new_path(df.sparkSession, f"llm-{label}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Just (``doc_id`` long, ``text`` string), whatever else the frame holds."""
    return docs.select(
        qcol(id_column).cast("bigint").alias("doc_id"),
        qcol(text_column).cast("string").alias("text"),
    )


def crc_of_id(id_column: Column) -> Column:
    """CRC32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(id_column.cast("string"), F.lit("")), "utf-8"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where the frame already has a column so called."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def numbered(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Rows with their 0-based place in the given order, in ranges and not in one task."""
    ranged = df.repartitionByRange(*order).select("*", F.spark_partition_id().alias("_part"))
    ranged = saved(ranged, "ranges")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    # One row per range from here to the join.
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    offsets = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = offsets.select("_part", before.alias("_before"))
    placed = ranged.withColumn("_row", within).join(offsets, "_part")
    return placed.select(*df.columns, (F.col("_before") + F.col("_row") - 1).alias(name))
