"""Positions and predecessors inside groups, without one task per group."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkprep.functions.columns import qcol

CHUNK = 100_000
MAX_RANGES = 10_000


def number_below(values: list[int], key: Column) -> Column:
    """How many of the sorted values are less than the key.

    Looks at every so manieth value first and then at the ones behind it.
    """
    step = math.isqrt(len(values)) + 1
    coarse = F.lit(np.array(values[::step], np.int64))
    fine = F.lit(np.array(values, np.int64))
    less = F.array_size(F.filter(coarse, lambda v: v < key))
    start = F.greatest(less - 1, F.lit(0)) * step
    part = F.slice(fine, start + 1, F.lit(step))
    return start + F.array_size(F.filter(part, lambda v: v < key))


def range_bounds(df: DataFrame, order: str, chunk: int = CHUNK) -> list[int]:
    """Order values that cut the rows into ranges of about ``chunk`` rows.

    One aggregate over the order column; no more than MAX_RANGES values come to
    the driver.
    """
    rows = df.select(qcol(order).cast("bigint").alias("o")).where("o IS NOT NULL")
    ranges = min(MAX_RANGES, math.ceil(rows.count() / chunk))
    if ranges < 2:
        return []
    shares = [i / ranges for i in range(1, ranges)]
    return sorted(set(rows.agg(F.percentile_approx("o", shares, 20 * ranges)).first()[0]))


def with_predecessor(
    df: DataFrame,
    group: str,
    order: str,
    previous: str = "previous",
    position: str = "position",
    chunk: int = CHUNK,
) -> DataFrame:
    """Add the preceding ``order`` value and the 1-based position in the group.

    ``order`` is an integer that is unique in its group. The rows are cut into
    ranges of about ``chunk`` rows by sampled order values, whatever their
    spacing, and a group's part of a range is a window partition of its own, so
    a single group with most of the rows is spread over many tasks. Every part
    is headed by one extra row, made from a summary with one row per part, that
    carries the last order value and the count of rows across from the parts
    before it. The bounds are looked up when this is called.
    """
    g, o = qcol(group), qcol(order)
    bounds = range_bounds(df, order, chunk)
    part = (number_below(bounds, o.cast("bigint")) if bounds else F.lit(0)).alias("_range")
    across = Window.partitionBy(g).orderBy("_range")
    headers = (
        df.groupBy(g, part)
        .agg(F.max(o).alias("_last"), F.count(F.lit(1)).alias("_n"))
        .select(
            g,
            "_range",
            F.lit(0).alias("_kind"),
            F.lag("_last").over(across).alias("_link"),
            (F.sum("_n").over(across) - F.col("_n")).alias("_offset"),
        )
    )
    rows = df.select("*", part, F.lit(1).alias("_kind"), o.alias("_link"))
    within = Window.partitionBy(g, F.col("_range")).orderBy("_kind", o)
    linked = rows.unionByName(headers, allowMissingColumns=True).select(
        "*",
        F.lag("_link").over(within).alias(previous),
        (F.first("_offset").over(within) + F.row_number().over(within) - 1).alias(position),
    )
    return linked.where("_kind = 1").drop("_range", "_kind", "_link", "_offset")
