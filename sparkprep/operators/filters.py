"""Row filters and missing-value predicates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.functions.columns import data_type, has_column, is_missing, is_present, qcol


def drop_missing(
    df: DataFrame, columns: Sequence[str] | None = None, how: str = "any"
) -> DataFrame:
    """Drop rows with any (or all) of the columns missing.

    Absent columns are ignored; if none of the named columns is present the
    frame is returned unchanged. The condition is a plain conjunction (or
    disjunction) of IS NOT NULL, which reaches the Parquet scan, unlike
    ``DataFrame.dropna``.
    """
    return df.where(rows_present(df, columns, how))


def rows_present(
    df: DataFrame, columns: Sequence[str] | None = None, how: str = "any"
) -> Column:
    """The rows that ``drop_missing`` keeps."""
    if how not in ("any", "all"):
        raise ValueError(f"how must be 'any' or 'all', not {how!r}")
    chosen = [n for n in df.columns if columns is None or n in columns]
    join = and_ if how == "any" else or_
    return reduce(join, [is_present(df, n) for n in chosen]) if chosen else F.lit(True)


def filter_equals(df: DataFrame, column: str, value: str) -> DataFrame:
    """Keep rows whose column equals the text, read as the column's type.

    The literal is cast, not the column, so the comparison is pushed down. A
    text that is no value of that type matches no row.
    """
    return df.where(equals(df, column, value))


def equals(df: DataFrame, column: str, value: str) -> Column:
    """The rows that ``filter_equals`` keeps: all, if the column is absent."""
    if not has_column(df, column):
        return F.lit(True)
    return qcol(column) == F.lit(value).try_cast(data_type(df, column))


def parse_filter(text: str) -> tuple[str, str]:
    """Split ``column:value`` at the first colon."""
    column, colon, value = text.partition(":")
    if not column or not colon:
        raise ValueError(f"expected 'column:value', got {text!r}")
    return column, value


def missing_count(df: DataFrame, column: str) -> Column:
    return F.count_if(is_missing(df, column))


def has_nulls(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row, one boolean per column: does it have a missing value?"""
    chosen = [n for n in df.columns if columns is None or n in columns]
    return df.agg(
        *[F.coalesce(F.bool_or(is_missing(df, n)), F.lit(False)).alias(n) for n in chosen]
    )
