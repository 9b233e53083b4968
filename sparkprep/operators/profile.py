"""Schema, shape, statistics and preview of a frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.functions.columns import (
    data_type,
    family,
    is_missing,
    is_numeric,
    null_if_nan,
    qcol,
)
from sparkprep.functions.statistics import SKETCH_GROUPS, SKETCH_SIZE, medians_table, modes_of
from sparkprep.operators.fill import default_fill_value, strategies_for
from sparkprep.operators.filters import missing_count

PREVIEW_ROWS = 5


def one_row_per_column(df: DataFrame, columns: Sequence[str], cells: dict[str, list[Column]]) -> DataFrame:
    """Turn one-row aggregates of ``df`` into one row per column.

    ``cells`` maps an output name to one aggregate per entry of ``columns``;
    all of them are evaluated in a single pass.
    """
    rows = [
        F.struct(
            F.lit(name).alias("column"), *[values[i].alias(label) for label, values in cells.items()]
        )
        for i, name in enumerate(columns)
    ]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def schema_table(df: DataFrame) -> DataFrame:
    """(position, name, type, family, present): schema and non-missing counts."""
    fields = df.schema.fields
    table = one_row_per_column(
        df,
        df.columns,
        {
            "position": [F.max(F.lit(i + 1).cast("bigint")) for i in range(len(fields))],
            "type": [F.max(F.lit(f.dataType.simpleString())) for f in fields],
            "family": [F.max(F.lit(family(f.dataType))) for f in fields],
            "present": [F.count(F.lit(1)) - missing_count(df, f.name) for f in fields],
        },
    )
    return table.select("position", F.col("column").alias("name"), "type", "family", "present")


def schema_list(df: DataFrame) -> list[dict[str, str]]:
    """The schema as ``[{"name", "type"}]``, without touching the data."""
    return [{"name": f.name, "type": f.dataType.simpleString()} for f in df.schema.fields]


def shape(df: DataFrame) -> DataFrame:
    """One row (rows, columns)."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.max(F.lit(len(df.columns)).cast("bigint")).alias("columns"),
    ).select("rows", F.coalesce("columns", F.lit(len(df.columns)).cast("bigint")).alias("columns"))


def profile_columns(
    df: DataFrame, columns: Sequence[str] | None = None, digits: int = 6
) -> DataFrame:
    """(column, missing, mean, median, mode) per column, mode as text.

    Six passes over the frame, however many columns it has: counts and means
    share one, all modes take two and all medians three.
    """
    chosen = [n for n in df.columns if columns is None or n in columns]
    numeric = [n for n in chosen if is_numeric(data_type(df, n))]
    plain = [n for n in chosen if not _nested(data_type(df, n))]
    nothing = F.max(F.lit(None).cast("double"))
    out = one_row_per_column(
        df,
        chosen,
        {
            "missing": [missing_count(df, n) for n in chosen],
            "mean": [
                F.avg(null_if_nan(df, n)).cast("double") if n in numeric else nothing
                for n in chosen
            ],
        },
    )
    for names, label, dtype, find in (
        (numeric, "median", "double", medians_table),
        (plain, "mode", "string", modes_of),
    ):
        if not names:
            out = out.withColumn(label, F.lit(None).cast(dtype))
            continue
        place = F.lit(names)[F.col("at")].alias("its")
        found = find(df, names).select(place, label)
        out = out.join(found, F.col("column") == F.col("its"), "left").drop("its")
    return out.select(
        "column",
        "missing",
        F.round("mean", digits).alias("mean"),
        F.round("median", digits).alias("median"),
        "mode",
    )


# --- profiles of parts, merged later ----------------------------------------

# Items whose frequency a part's profile keeps; for the size of the other sketch and
# the number of groups see ``statistics``.
STATE_ITEMS = 384
STATE_COLUMNS = ("rows", "missing", "n", "total", "quantiles", "items")


def profile_state(df: DataFrame) -> DataFrame:
    """(column, rows, missing, n, total, quantiles, items): what the profile of a part needs.

    Rows and missing values; for numbers how many there are, their sum and a
    sketch of their order; for all but nested columns a sketch of frequent values, as
    text. One pass. States of parts are merged by ``merged_states`` in any order.
    """
    cells, rows = [], []
    for i, name in enumerate(df.columns):
        dtype = data_type(df, name)
        value = null_if_nan(df, name)
        number = value.cast("double") if is_numeric(dtype) else F.lit(None).cast("double")
        text = F.lit(None).cast("string") if _nested(dtype) else value.cast("string")
        cells += [number.alias(f"d{i}"), text.alias(f"t{i}"), is_missing(df, name).alias(f"m{i}")]
        rows.append(
            f"named_struct('column', c[{i}], 'rows', rows, 'missing', missing{i}, 'n', n{i},"
            f" 'total', total{i}, 'quantiles', q{i}, 'items', i{i})"
        )
    sums = ", ".join(
        f"count_if(m{i}) AS missing{i}, count(d{i}) AS n{i}, sum(d{i}) AS total{i},"
        f" IF(count(d{i}) > 0, kll_sketch_agg_double(d{i}, {SKETCH_SIZE}), NULL) AS q{i},"
        f" approx_top_k_accumulate(t{i}, {STATE_ITEMS}) AS i{i}"
        for i in range(len(df.columns))
    )
    text = (
        f"SELECT inline(array({', '.join(rows)})) FROM (SELECT count(1) AS rows, first(c) AS c, {sums}"
        f" FROM {{rows}} GROUP BY spark_partition_id() % {SKETCH_GROUPS})"
    )
    named = F.lit(df.columns).alias("c")
    return merged_states(df.sparkSession.sql(text, rows=df.select(*cells, named)))


def merged_states(states: DataFrame) -> DataFrame:
    """One state per column from those of parts."""
    return states.groupBy("column").agg(
        F.sum("rows").alias("rows"),
        F.sum("missing").alias("missing"),
        F.sum("n").alias("n"),
        F.sum("total").alias("total"),
        F.expr(f"IF(sum(n) > 0, kll_merge_agg_double(quantiles, {SKETCH_SIZE}), NULL)").alias("quantiles"),
        F.expr(f"approx_top_k_combine(items, {STATE_ITEMS})").alias("items"),
    )


def profile_of_states(states: DataFrame, digits: int = 6) -> DataFrame:
    """(column, rows, missing, mean, median, mode) from states of parts.

    Rows, missing values and means are exact, but for the rounding of sums of doubles.
    The median is off by at most 0.13 % of the ranks, and the mode is one of the most
    frequent values: null where none of them is frequent enough to be told.
    """
    named = "filter(approx_top_k_estimate(items, 2), x -> x.item IS NOT NULL)"
    return merged_states(states).select(
        "column",
        "rows",
        "missing",
        F.round(F.expr("try_divide(total, n)"), digits).alias("mean"),
        F.round(
            F.expr("IF(n > 0, kll_sketch_get_quantile_double(quantiles, double('0.5')), NULL)"), digits
        ).alias("median"),
        F.expr(f"get({named}, 0).item").alias("mode"),
    )


def _nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.MapType, T.ArrayType, T.StructType))


def fill_strategies(df: DataFrame) -> DataFrame:
    """(column, missing, strategies, default_value) for columns to fill."""
    types = [f.dataType for f in df.schema.fields]
    table = one_row_per_column(
        df,
        df.columns,
        {
            "missing": [missing_count(df, n) for n in df.columns],
            "strategies": [F.max(F.lit(",".join(strategies_for(t)))) for t in types],
            "default_value": [F.max(F.lit(default_fill_value(t))) for t in types],
        },
    )
    return table.where(F.col("missing") > 0)


def preview(df: DataFrame, rows: int = PREVIEW_ROWS, order_by: Sequence[str] = ()) -> DataFrame:
    """The first rows; in a defined order only if one is given."""
    return (df.orderBy(*[qcol(n) for n in order_by]) if order_by else df).limit(rows)
