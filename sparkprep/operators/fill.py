"""Filling missing values.

Statistics are scalar subqueries over ``stats`` (by default the frame itself),
so nothing is computed until the result is used. Passing a batch table as
``stats`` lets the same fills run on a stream.
"""

from __future__ import annotations

from decimal import Decimal, InvalidOperation

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.functions.columns import (
    data_type,
    family,
    has_column,
    is_numeric,
    null_if_nan,
    qcol,
    replace_column,
)
from sparkprep.functions.statistics import (
    any_missing,
    approximate_median_of,
    filled_type,
    fitted,
    mean_of,
    median_of,
    mode_of,
)

# Strategy names and the defaults offered for a constant fill.
MEAN, MEDIAN, MODE, SPECIFIC = "fill_mean", "fill_median", "fill_mode", "fill_specific"
STRATEGIES = (MEAN, MEDIAN, MODE, SPECIFIC)
DEFAULT_NUMBER, DEFAULT_TEXT = "0", "UNKNOWN"

_WHOLE_TYPES = (
    (T.ByteType, 8),
    (T.ShortType, 16),
    (T.IntegerType, 32),
    (T.LongType, 64),
)


def _fill_number(df: DataFrame, column: str, statistic: Column) -> DataFrame:
    target = filled_type(df, column)
    value = F.coalesce(
        null_if_nan(df, column).cast(target), fitted(statistic, target).cast(target)
    )
    return replace_column(df, column, value)


def takes_number(df: DataFrame, column: str) -> bool:
    return has_column(df, column) and is_numeric(data_type(df, column))


def fill_mean(df: DataFrame, column: str, stats: DataFrame | None = None) -> DataFrame:
    """Fill with the mean. Integer columns become double."""
    if not takes_number(df, column):
        return df
    return _fill_number(df, column, mean_of(df if stats is None else stats, column))


def fill_median(
    df: DataFrame,
    column: str,
    approx: bool = False,
    stats: DataFrame | None = None,
    median: Column | None = None,
) -> DataFrame:
    """Fill with the exact median, or with a sketch's estimate if ``approx``.

    ``median`` gives it where it is known already, as with ``medians_of``.
    """
    if not takes_number(df, column):
        return df
    source = df if stats is None else stats
    if median is None:
        median = approximate_median_of(source, column) if approx else median_of(source, column)
    return _fill_number(df, column, median)


def has_mode(df: DataFrame, column: str) -> bool:
    """Whether the column's values can be counted and ordered."""
    return has_column(df, column) and not isinstance(
        data_type(df, column), (T.MapType, T.VariantType)
    )


def fill_mode(df: DataFrame, column: str, stats: DataFrame | None = None) -> DataFrame:
    """Fill with the most frequent value, the smallest one on a tie."""
    if not has_mode(df, column):
        return df
    statistic = mode_of(df if stats is None else stats, column)
    return replace_column(df, column, F.coalesce(null_if_nan(df, column), statistic))


def fill_value(
    df: DataFrame,
    column: str,
    value: object,
    only_if_nulls: bool = True,
    stats: DataFrame | None = None,
) -> DataFrame:
    """Fill with a constant.

    In a string column the empty text is missing too, but it is replaced only
    if the column has at least one null; ``only_if_nulls=False`` replaces it
    regardless. A value that does not fit the column's type is an error.
    """
    if value is None or not has_column(df, column):
        return df
    target = constant_type(data_type(df, column), value)
    literal = F.lit(value).cast(target)
    if family(target) != "string":
        return replace_column(
            df, column, F.coalesce(null_if_nan(df, column).cast(target), literal)
        )
    filled = F.coalesce(F.nullif(qcol(column), F.lit("")), literal)
    if only_if_nulls:
        filled = F.when(any_missing(df if stats is None else stats, column), filled).otherwise(
            qcol(column)
        )
    return replace_column(df, column, filled)


def constant_type(dtype: T.DataType, value: object) -> T.DataType:
    """Type of the column once ``value`` is in it; TypeError if it cannot be."""
    kind = family(dtype)
    if kind == "string" and isinstance(value, str):
        return dtype
    if kind == "boolean" and isinstance(value, bool):
        return dtype
    if kind == "datetime" and not isinstance(value, (bool, int, float)):
        return dtype
    if isinstance(value, (int, float, Decimal)) and not isinstance(value, bool):
        if kind == "float":
            if isinstance(dtype, T.DecimalType):
                return _decimal_type(dtype, value)
            return dtype
        if kind == "int":
            return _whole_type(dtype, value)
    raise TypeError(f"cannot fill a {dtype.simpleString()} column with {value!r}")


def _whole_type(dtype: T.DataType, value: int | float | Decimal) -> T.DataType:
    if value != int(value):
        return T.DoubleType()
    own = next(i for i, (cls, _) in enumerate(_WHOLE_TYPES) if isinstance(dtype, cls))
    for cls, bits in _WHOLE_TYPES[own:]:
        if -(1 << (bits - 1)) <= value < 1 << (bits - 1):
            return cls()
    return T.DoubleType()


def _decimal_type(dtype: T.DecimalType, value: int | float | Decimal) -> T.DecimalType:
    try:
        exact = Decimal(str(value)).normalize()
    except InvalidOperation:
        raise TypeError(f"{value!r} is not a decimal") from None
    sign, digits, exponent = exact.as_tuple()
    scale = max(dtype.scale, -exponent, 0)
    whole = max(dtype.precision - dtype.scale, len(digits) + exponent)
    if whole + scale > 38:
        raise TypeError(f"{value!r} does not fit {dtype.simpleString()}")
    return T.DecimalType(whole + scale, scale)


def coerce_fill_value(text: str, dtype: T.DataType) -> object:
    """Read a typed-in fill value: a float if it has a dot, an int if not."""
    if not is_numeric(dtype) or not text:
        return text
    parse = float if "." in text else int
    return parse(text)


def strategies_for(dtype: T.DataType) -> tuple[str, ...]:
    """The strategies to offer for a column of this type."""
    return (MEAN, MEDIAN, SPECIFIC) if is_numeric(dtype) else (MODE, SPECIFIC)


def default_fill_value(dtype: T.DataType) -> str:
    return DEFAULT_NUMBER if is_numeric(dtype) else DEFAULT_TEXT
