"""Column statistics as scalar subqueries.

Each function returns a ``Column`` that stands for one value computed over the
whole frame, so a fill stays a single lazy plan and needs no join. Catalyst
merges the subqueries of several fills over the same source into one
aggregate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.functions.columns import data_type, is_missing, is_present, null_if_nan, qcol

# Size parameter of the sketches, and the number of groups whose sketches are
# merged first.
SKETCH_SIZE = 4096
SKETCH_GROUPS = 256

# A sketch's rank error, which one in a hundred exceeds, is the first number
# over a power of its size. Brackets are three times as wide, on both sides.
MARGIN = 3 * 2.296 / SKETCH_SIZE**0.9021
# Ranks at which the second sketch is asked for values.
GRID = 512
# Items that sketches of frequent items are asked to keep. They then have
# room for a power of two of them, and their error is at most the share 3.5 over that.
ITEMS = 3072
ITEMS_ERROR = 3.5 / 4096
MISSED = "a median is outside its bracket; run the query again"


def values_of(df: DataFrame, name: str) -> DataFrame:
    """The non-missing values of one column, as column ``v``."""
    return df.where(is_present(df, name)).select(qcol(name).alias("v"))


def mean_of(df: DataFrame, name: str) -> Column:
    return df.agg(F.avg(null_if_nan(df, name))).scalar()


def mode_of(df: DataFrame, name: str) -> Column:
    """Most frequent value, the smallest one on a tie; null if there is none.

    One pass finds what the mode can be, see ``_likely_modes_sql``, a second one counts
    those values, or all if that is not known. Counts are combined before the
    shuffle and the winner is a top-1, so no task holds all distinct values.
    """
    types = [data_type(df, name)]
    likely = f"SELECT v0, ({_likely_modes_sql(types)}) AS k FROM {{rows}}"
    counts = f"SELECT v0 AS v, count(1) AS n FROM ({likely}) WHERE {_may_win_sql(0, types[0])} GROUP BY v0"
    text = f"SELECT v FROM ({counts}) ORDER BY n DESC, v LIMIT 1"
    rows = values_of(df, name).withColumnRenamed("v", "v0")
    return df.sparkSession.sql(text, rows=rows).scalar()


def _hash_sql(at: int, dtype: T.DataType) -> str | None:
    """A hash that equal values share, or None for types where that is not sure."""
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        return None
    if isinstance(dtype, T.StringType) and dtype != T.StringType():
        return None
    # Minus zero is zero.
    floating = isinstance(dtype, (T.DoubleType, T.FloatType))
    return f"xxhash64(v{at} + 0D)" if floating else f"xxhash64(v{at})"


def _may_win_sql(at: int, dtype: T.DataType) -> str:
    hashed = _hash_sql(at, dtype)
    return f"(k.k{at} IS NULL OR array_contains(k.k{at}, {hashed}))" if hashed else "TRUE"


def _likely_modes_sql(types: Sequence[T.DataType]) -> str:
    """For columns v0, v1, ... of ``{rows}``: the hashes that the mode's may be, as a struct.

    A field is null where every value may be the mode.

    The items that sketches keep have hardly more memory than a hash each, whatever the
    values are; sketches are merged as those of medians are. A sketch over n rows
    says of an item how often it comes, too much by at most n times ITEMS_ERROR, and
    tells of all items that come more than twice as often as that. So where the
    first item comes more often than three times that, the mode is among those that
    come nearly as often. (Two values of one hash only make that more than it need be.)
    """
    hashes = {i: _hash_sql(i, t) for i, t in enumerate(types)}
    known = [i for i, h in hashes.items() if h]
    in_groups = ["count(1) AS n"] + [
        f"approx_top_k_accumulate(IF(v{i} IS NULL, NULL, {hashes[i]}), {ITEMS}) AS s{i}" for i in known
    ]
    merged = [f"coalesce(sum(n), 0) * {ITEMS_ERROR}D AS error"] + [
        f"filter(approx_top_k_estimate(approx_top_k_combine(s{i}, {ITEMS}), {ITEMS}),"
        f" x -> x.item IS NOT NULL) AS e{i}"
        for i in known
    ]
    fields = []
    for i in hashes:
        near = f"filter(e{i}, x -> x.count >= e{i}[0].count - 2 * error)"
        fields.append(
            f"'k{i}', "
            + (
                f"IF(get(e{i}, 0).count > 3 * error, transform({near}, x -> x.item), NULL)"
                if hashes[i]
                else "CAST(NULL AS array<bigint>)"
            )
        )
    grouped = (
        f"SELECT {', '.join(in_groups)} FROM {{rows}} GROUP BY spark_partition_id() % {SKETCH_GROUPS}"
    )
    # One group if there are rows, and else none: sketches of no rows cannot be combined.
    combined = f"SELECT {', '.join(merged)} FROM ({grouped}) GROUP BY n < 0"
    return f"SELECT named_struct({', '.join(fields)}) FROM ({combined})"


def any_missing(df: DataFrame, name: str) -> Column:
    """EXISTS, which stops at the first missing value."""
    return df.where(is_missing(df, name)).exists()


def approximate_median_of(df: DataFrame, name: str) -> Column:
    """Median by a sketch, in one pass."""
    sketch = _sketched_sql("SELECT * FROM {rows}", {"n0": "count(v)"}, {"s0": "double(v)"})
    found = "IF(n0 > 0, kll_sketch_get_quantile_double(s0, double('0.5')), NULL) AS median"
    text = f"SELECT {found} FROM ({sketch})"
    return df.sparkSession.sql(text, rows=values_of(df, name)).scalar()


def median_of(df: DataFrame, name: str) -> Column:
    """Exact median (mean of the two middle values on an even count)."""
    return medians_of(df, [name])[median_field(0)]


def median_field(at: int) -> str:
    return f"m{at}"


def medians_of(df: DataFrame, names: list[str]) -> Column:
    """The exact medians of numeric columns as one scalar struct, with a field for each.

    However many columns there are, they share the three passes of
    ``median_rows``. The mean of two middle values has the type that ``avg`` gives.
    """
    found, fields = median_rows(df, names)
    cells = (f"max(IF(at = {at}, {f}, NULL)) AS {median_field(at)}" for at, f in enumerate(fields))
    return found.agg(*map(F.expr, cells)).select(F.struct("*")).scalar()


def median_rows(df: DataFrame, names: list[str]) -> tuple[DataFrame, list[str]]:
    """A row per numeric column that has values: its place ``at`` and, in a field, its median.

    Also the names of these fields, one for each column; columns of a type share one.

    Two passes narrow down where the middle ranks are. The first one sketches the
    values of each column and takes a bracket around the sketch's median that
    is three times as wide as its error. The second one counts the values below
    the bracket, which is exact, and sketches those inside, for a bracket inside
    the bracket. What is in there, about a ten-thousandth of the values unless
    they repeat, is counted by value in a third pass and put in order, with exact counts
    of what is below. So the result is exact whatever the sketches say. Were a
    rank outside its bracket, of which the chance is far under 1e-12, the query would
    fail rather than give another value.

    Brackets are of doubles, whose order is that of every numeric type; the values in the
    last bracket keep their own type. The passes are the same for every type and size.
    """
    present = [F.when(is_present(df, n), qcol(n)).alias(f"v{i}") for i, n in enumerate(names)]
    rows = df.select(present)
    types = [data_type(df, name).simpleString() for name in names]
    text, fields = _medians_sql(types)
    # As one statement: a frame per step would take longer to build than to compute.
    return df.sparkSession.sql(text, rows=rows), fields


def _sketched_sql(
    rows: str,
    counts: Mapping[str, str],
    sketched: Mapping[str, str],
    constants: Sequence[str] = (),
) -> str:
    """One row: counts, sketches of what the expressions give, and columns that never vary.

    Sketches of tasks are merged in groups and then once more, so the last
    merge sees a fixed number of them, however many tasks there are. (A sketch of
    nothing cannot be merged.)
    """
    size = SKETCH_SIZE
    in_groups = [
        *(f"{c} AS {n}" for n, c in counts.items()),
        *(
            f"IF(count({v}) > 0, kll_sketch_agg_double({v}, {size}), NULL) AS {n}"
            for n, v in sketched.items()
        ),
        *(f"max({n}) AS {n}" for n in constants),
    ]
    merged = [
        *(f"coalesce(sum({n}), 0) AS {n}" for n in counts),
        *(f"kll_merge_agg_double({n}, {size}) AS {n}" for n in sketched),
        *(f"max({n}) AS {n}" for n in constants),
    ]
    return (
        f"SELECT {', '.join(merged)} FROM (SELECT {', '.join(in_groups)} FROM ({rows})"
        f" GROUP BY spark_partition_id() % {SKETCH_GROUPS})"
    )


def _medians_sql(types: Sequence[str]) -> tuple[str, list[str]]:
    """The statement for columns v0, v1, ... of ``{rows}`` of these types, and the fields."""
    n = len(types)
    doubles = ", ".join(f"double(v{i}) AS d{i}" for i in range(n))
    rows = f"SELECT *, {doubles} FROM {{rows}}" + (" WHERE v0 IS NOT NULL" if n == 1 else "")
    first = _first_brackets_sql(rows, n)
    second = _second_brackets_sql(f"SELECT *, ({first}) AS b FROM ({rows})", n)
    return _middles_sql(f"SELECT *, ({second}) AS b FROM ({rows})", types)


def _first_brackets_sql(rows: str, n: int) -> str:
    """Lower and upper bound for each column, as an array."""
    merged = _sketched_sql(
        rows,
        {f"n{i}": f"count(d{i})" for i in range(n)},
        {f"s{i}": f"d{i}" for i in range(n)},
    )
    bounds = ", ".join(
        f"IF(n{i} > 0, kll_sketch_get_quantile_double(s{i}, double('{rank}')), NULL)"
        for i in range(n)
        for rank in (0.5 - MARGIN, 0.5 + MARGIN)
    )
    return f"SELECT array({bounds}) FROM ({merged})"


def _second_brackets_sql(rows: str, n: int) -> str:
    """For each column, in an array: the lower bound of the first bracket, both bounds of the
    second one, how many values are below the first, and how many there are."""
    bounds = ", ".join(
        f"d{i}, b[{2 * i}] AS low{i}, b[{2 * i + 1}] AS high{i}" for i in range(n)
    )
    counts, sketched = {}, {}
    for i in range(n):
        inside = f"IF(d{i} >= low{i} AND d{i} <= high{i}, d{i}, NULL)"
        counts[f"n{i}"] = f"count(d{i})"
        counts[f"u{i}"] = f"count_if(d{i} < low{i})"
        counts[f"c{i}"] = f"count({inside})"
        sketched[f"s{i}"] = inside
    lows = [f"low{i}" for i in range(n)]
    merged = _sketched_sql(f"SELECT {bounds} FROM ({rows})", counts, sketched, lows)
    # As one literal: an array of so many would be looked at in every rule of the optimizer.
    grid = f"CAST(split('{' '.join(str(g / GRID) for g in range(GRID + 1))}', ' ') AS array<double>)"
    quantiles = ", ".join(
        f"CASE WHEN n{i} = 0 THEN NULL"
        f" WHEN (n{i} - 1) div 2 < u{i} OR n{i} div 2 >= u{i} + c{i}"
        f" THEN CAST(raise_error('{MISSED}') AS array<double>)"
        f" ELSE kll_sketch_get_quantile_double(s{i}, {grid}) END AS q{i}"
        for i in range(n)
    )
    # Places in the grid that are surely not above, and not below, the two middle ranks.
    cells = ", ".join(
        f"low{i},"
        f" q{i}[int(greatest(floor((((n{i} - 1) div 2 - u{i}) / c{i} - {MARGIN}D) * {GRID}), 0))],"
        f" q{i}[int(least(ceil(((n{i} div 2 - u{i} + 1) / c{i} + {MARGIN}D) * {GRID}), {GRID}))],"
        f" double(u{i}), double(n{i})"
        for i in range(n)
    )
    return f"SELECT array({cells}) FROM (SELECT *, {quantiles} FROM ({merged}))"


def _middles_sql(rows: str, types: Sequence[str]) -> tuple[str, list[str]]:
    distinct = list(dict.fromkeys(types))
    fields = [f"t{distinct.index(t)}" for t in types]
    used = [f"t{k}" for k in range(len(distinct))]
    cells, wanted = [], []
    for i, own in enumerate(types):
        first, low, high, under, total = (f"b[{5 * i + k}]" for k in range(5))
        values = ", ".join(
            f"'t{k}', " + (f"IF(d{i} < {low}, NULL, v{i})" if t == own else f"CAST(NULL AS {t})")
            for k, t in enumerate(distinct)
        )
        wanted.append(f"(d{i} >= {first} AND d{i} <= {high})")
        entry = f"'at', {i}, 'below', d{i} < {low}, 'under', {under}, 'n', {total}, {values}"
        cells.append(f"IF({wanted[-1]}, named_struct({entry}), NULL)")
    keys = ", ".join(["at", "below", "under", "n", *used])
    # Few rows have a value in a bracket. One column's are put in order by one task
    # anyway, which may as well count them.
    entries = f"SELECT explode(array({', '.join(cells)})) AS p FROM ({rows}) WHERE {' OR '.join(wanted)}"
    counted = f"SELECT {keys}, count(1) AS c FROM (SELECT p.* FROM ({entries}) WHERE p IS NOT NULL) GROUP BY {keys}"
    hint = "/*+ COALESCE(1) */ " if len(types) == 1 else ""
    order = f"PARTITION BY at ORDER BY below DESC, {', '.join(used)} ROWS UNBOUNDED PRECEDING"
    placed = f"SELECT *, under + sum(c) OVER ({order}) AS upto FROM (SELECT {hint}* FROM ({counted}))"
    ranks = "floor((n - 1) / 2)", "floor(n / 2)"
    holds = " OR ".join(f"(upto - c <= {r} AND {r} < upto)" for r in ranks)
    means = ", ".join(f"avg(IF(holds, {f}, NULL)) AS {f}" for f in used)
    middle = (
        f"SELECT at, {means}, bool_or(holds) AS held FROM"
        f" (SELECT *, NOT below AND ({holds}) AS holds FROM ({placed})) GROUP BY at"
    )
    told = f"IF(held, at, int(raise_error('{MISSED}'))) AS at"
    return f"SELECT {told}, {', '.join(used)} FROM ({middle})", fields


def medians_table(df: DataFrame, names: list[str]) -> DataFrame:
    """(at, median) for the numeric columns at these places of ``names``, exact, as doubles."""
    found, fields = median_rows(df, names)
    values = [F.col(f).cast("double") for f in dict.fromkeys(fields)]
    return found.select("at", F.coalesce(*values).alias("median"))


def modes_of(df: DataFrame, names: list[str]) -> DataFrame:
    """(at, mode) as text for the columns at these places of ``names``, in two passes.

    All values that may be a mode are counted together, by column number and value,
    with a field for each type that the columns have, so that ties go to the
    smallest value of its own type.
    """
    own = [data_type(df, n) for n in names]
    types = list(dict.fromkeys(t.simpleString() for t in own))
    fields = ", ".join(f"t{k}" for k in range(len(types)))
    present = [F.when(is_present(df, n), qcol(n)).alias(f"v{i}") for i, n in enumerate(names)]
    cells = []
    for i, dtype in enumerate(own):
        values = ", ".join(
            f"'t{k}', " + (f"v{i}" if dtype.simpleString() == t else f"CAST(NULL AS {t})")
            for k, t in enumerate(types)
        )
        counts = f"v{i} IS NOT NULL AND {_may_win_sql(i, dtype)}"
        cells.append(f"IF({counts}, named_struct('at', {i}, {values}), NULL)")
    rows = f"SELECT *, ({_likely_modes_sql(own)}) AS k FROM {{rows}}"
    entries = f"SELECT p.* FROM (SELECT explode(array({', '.join(cells)})) AS p FROM ({rows})) WHERE p IS NOT NULL"
    counts = f"SELECT at, {fields}, count(1) AS n FROM ({entries}) GROUP BY at, {fields}"
    best = f"SELECT at, min(struct(-n AS n, {fields})) AS b FROM ({counts}) GROUP BY at"
    shown = ", ".join(f"CAST(b.t{k} AS string)" for k in range(len(types)))
    text = f"SELECT at, coalesce({shown}) AS mode FROM ({best})"
    return df.sparkSession.sql(text, rows=df.select(present))


def fitted(statistic: Column, dtype: T.DataType) -> Column:
    """A mean or median in the type the filled column will have."""
    return statistic.cast(dtype) if isinstance(dtype, T.DecimalType) else statistic.cast("double")


def filled_type(df: DataFrame, name: str) -> T.DataType:
    """Type of a numeric column after a mean or median fill: integers widen."""
    dtype = data_type(df, name)
    return dtype if isinstance(dtype, (T.DecimalType, T.FloatType)) else T.DoubleType()
