"""Filling missing values and the statistics behind it."""

import random
import statistics
from collections import Counter
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.functions import statistics as stats
from sparkprep.operators import fill
from sparkprep.operators.duplicates import remove_duplicates
from sparkprep.operators.profile import (
    fill_strategies,
    profile_columns,
    schema_list,
    schema_table,
    shape,
)
from sparkprep.plans.cleaning import apply_steps
from sparkprep.plans.steps import FillNulls

NAN = float("nan")


def values(df, name="v"):
    return [r[name] for r in df.collect()]


def frame(spark, items, dtype="double"):
    return spark.createDataFrame([(i,) for i in items], f"v {dtype}")


def test_mean_and_median_ignore_null_and_nan(spark):
    df = frame(spark, [1.0, NAN, None, 4.0])
    assert values(fill.fill_mean(df, "v")) == [1.0, 2.5, 2.5, 4.0]
    assert values(fill.fill_median(df, "v")) == [1.0, 2.5, 2.5, 4.0]


def test_integer_columns_widen(spark):
    df = frame(spark, [1, 2, None], "int")
    filled = fill.fill_mean(df, "v")
    assert filled.schema["v"].dataType == T.DoubleType()
    assert values(filled) == [1.0, 2.0, 1.5]
    assert values(fill.fill_value(df, "v", 2.5)) == [1.0, 2.0, 2.5]
    assert values(fill.fill_value(df, "v", 7)) == [1, 2, 7]
    assert fill.fill_value(df, "v", 1 << 40).schema["v"].dataType == T.LongType()


def test_decimal_columns_keep_their_type(spark):
    df = frame(spark, [Decimal("1.00"), Decimal("2.01"), None], "decimal(10,2)")
    assert fill.fill_mean(df, "v").schema["v"].dataType == T.DecimalType(10, 2)
    assert values(fill.fill_median(df, "v"))[2] == Decimal("1.51")
    assert values(fill.fill_value(df, "v", 0.125))[2] == Decimal("0.125")


def test_mode_takes_the_smallest_on_a_tie(spark):
    df = frame(spark, ["b", "a", "b", "a", None, None, None], "string")
    assert values(fill.fill_mode(df, "v"))[4:] == ["a"] * 3


def test_all_null_columns(spark):
    df = frame(spark, [None, None])
    for result in (fill.fill_mean(df, "v"), fill.fill_median(df, "v"), fill.fill_mode(df, "v")):
        assert values(result) == [None, None]
    assert values(fill.fill_value(df, "v", 1)) == [1.0, 1.0]


def test_guards_leave_the_frame_alone(spark):
    df = frame(spark, ["x", None], "string")
    assert fill.fill_mean(df, "v") is df
    assert fill.fill_median(df, "v") is df
    assert fill.fill_mean(df, "absent") is df
    assert fill.fill_mode(df, "absent") is df
    assert fill.fill_value(df, "v", None) is df
    maps = spark.createDataFrame([({"a": 1},)], "v map<string,int>")
    assert fill.fill_mode(maps, "v") is maps


def test_empty_text_is_missing_only_beside_nulls(spark):
    with_null = frame(spark, ["", "a", None], "string")
    without = frame(spark, ["", "a"], "string")
    assert values(fill.fill_value(with_null, "v", "U")) == ["U", "a", "U"]
    assert values(fill.fill_value(without, "v", "U")) == ["", "a"]
    assert values(fill.fill_value(without, "v", "U", only_if_nulls=False)) == ["U", "a"]


@pytest.mark.parametrize(
    "dtype, value",
    [("int", "z"), ("string", 1), ("boolean", 1), ("int", True), ("date", 5), ("array<int>", 1)],
)
def test_type_mismatch_is_an_error(spark, dtype, value):
    with pytest.raises(TypeError):
        fill.fill_value(frame(spark, [None], dtype), "v", value)


def test_dates_and_booleans(spark):
    dates = fill.fill_value(frame(spark, [None], "date"), "v", "2024-02-29")
    assert str(values(dates)[0]) == "2024-02-29"
    assert values(fill.fill_value(frame(spark, [None], "boolean"), "v", True)) == [True]


def test_coercion_and_strategies():
    assert fill.coerce_fill_value("1.5", T.DoubleType()) == 1.5
    assert fill.coerce_fill_value("15", T.DoubleType()) == 15
    assert fill.coerce_fill_value("15", T.StringType()) == "15"
    with pytest.raises(ValueError):
        fill.coerce_fill_value("x", T.IntegerType())
    assert fill.strategies_for(T.IntegerType()) == ("fill_mean", "fill_median", "fill_specific")
    assert fill.strategies_for(T.BooleanType()) == ("fill_mode", "fill_specific")


def narrowed(spark, items, dtype="double"):
    df = frame(spark, items, dtype)
    return spark.range(1).select(stats.median_of(df, "v")).first()[0]


@pytest.mark.parametrize(
    "items",
    [
        [1.0, 2.0, 3.0, 10.0],
        [5.0],
        [5.0, 7.0],
        [2.0] * 50 + [1.0, 9.0],
        [float("inf"), 1.0, 2.0],
        [float("-inf"), float("-inf"), 3.0, float("inf")],
        [-0.0, 0.0, 1e-300, 1e300, -1e300],
        [5e-324, 1e-323, 2.2250738585072014e-308, 1.5e-323],
        [1e308, 1.7e308, -1.7e308],
        [-8.0, -8.0, 1.0, 1024.0],
        [1.0, 1.0, 512.0, 513.0],
        [4.0, 4.5, 7.0, 7.5],
        [2.0**k for k in range(-1022, 1024)],
        [-(2.0**k) * (1 - 2.0**-53) for k in range(-1021, 1024)],
    ],
)
def test_median_on_small_frames(spark, items):
    assert narrowed(spark, items) == statistics.median(items)


@pytest.mark.parametrize("n", [1000, 1001])
def test_median_on_spread_and_skewed_values(spark, n):
    rng = random.Random(n)
    spread = [rng.uniform(-1e6, 1e6) for _ in range(n)]
    skewed = [0.5] * (n // 3) + [rng.expovariate(1) ** 8 for _ in range(n - n // 3)]
    near = [1.0 + i * 2.0**-40 for i in range(n)] + [1.9]
    for items in (spread, skewed, near):
        assert narrowed(spark, items) == pytest.approx(statistics.median(items), rel=1e-15)


def test_median_of_other_types(spark):
    big = [(1 << 60) + i for i in range(5)]
    assert narrowed(spark, big, "bigint") == float(big[2])
    assert narrowed(spark, [Decimal("1.10"), Decimal("1.20")], "decimal(5,2)") == Decimal("1.15")
    assert narrowed(spark, [-(1 << 63), (1 << 63) - 1, 5], "bigint") == 5.0
    assert narrowed(spark, [-40000, 70000, 3, 4], "int") == 3.5
    assert narrowed(spark, [-3, 7, 5], "smallint") == 5.0
    assert narrowed(spark, [0.1, 0.2, 0.3], "float") == pytest.approx(0.2)
    assert narrowed(spark, [], "double") is None
    assert narrowed(spark, [None, NAN]) is None
    huge = [Decimal("12345678901234567891")] * 3
    assert narrowed(spark, huge, "decimal(20,0)") == huge[0]
    wide = [Decimal(f"{s}1234567890123456789012345.{d:08d}") for s in ("-", "") for d in (7, 9)]
    assert narrowed(spark, [*wide, Decimal("0.5")], "decimal(38,8)") == Decimal("0.5")


def test_median_fill_keeps_a_decimal_exact(spark):
    exact = Decimal("12345678901234567891")
    df = frame(spark, [exact, exact, exact, None], "decimal(20,0)")
    assert values(fill.fill_median(df, "v")) == [exact] * 4


def scans(df):
    """How often the plan, with its subqueries, reads files."""
    execution = df._jdf.queryExecution()
    return df.sparkSession._jvm.PythonSQLUtils.explainString(execution, "simple").count("FileScan")


@pytest.mark.parametrize("columns", [1, 3])
def test_medians_of_a_run_of_fills_share_their_passes(spark, columns):
    source = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    run = [FillNulls(n, "fill_median") for n in ("l_tax", "l_discount", "l_linenumber")[:columns]]
    assert scans(apply_steps(source, run)) == 4


def test_medians_of_several_types_together(spark):
    rows = [(i, i * 0.5, Decimal(i) / 8, float(-i), None if i else 7) for i in range(10)]
    frame = spark.createDataFrame(rows * 3, "a int, b double, c decimal(30,3), d float, e bigint")
    names = [*frame.columns, "a"]
    found = spark.range(1).select(stats.medians_of(frame, names)).first()[0]
    assert list(found) == [4.5, 2.25, Decimal("0.5625"), -4.5, 7.0, 4.5]
    nothing = spark.range(1).select(stats.medians_of(frame.where("a < 0"), names)).first()[0]
    assert nothing is None or list(nothing) == [None] * 6


@pytest.mark.parametrize("n", [40_000, 40_001])
def test_medians_that_need_both_brackets(spark, monkeypatch, n):
    """Small sketches, whose brackets leave most values out."""
    monkeypatch.setattr(stats, "SKETCH_SIZE", 64)
    monkeypatch.setattr(stats, "MARGIN", 3 * 2.296 / 64**0.9021)
    monkeypatch.setattr(stats, "GRID", 16)
    rng = random.Random(n)
    columns = [
        [rng.uniform(-1, 1) for _ in range(n)],
        [rng.expovariate(1) ** 9 for _ in range(n)],
        [0.25 if rng.random() < 0.34 else rng.random() for _ in range(n)],
        [float(rng.randrange(5)) for _ in range(n)],
        [1.0 + i * 2.0**-40 for i in range(n - 1)] + [1e300],
    ]
    frame = spark.createDataFrame(list(zip(*columns, strict=True)), "a double, b double, c double, d double, e double")
    found = spark.range(1).select(stats.medians_of(frame.repartition(7), frame.columns)).first()[0]
    assert list(found) == pytest.approx([statistics.median(c) for c in columns], rel=1e-15)


def test_a_rank_outside_its_bracket_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(stats, "SKETCH_SIZE", 8)
    monkeypatch.setattr(stats, "MARGIN", -0.45)
    with pytest.raises(Exception, match="outside"):
        narrowed(spark, [float(i) for i in range(5000)])


def likely_modes(df):
    """The hashes that the sketches leave for each column."""
    types = [f.dataType for f in df.schema.fields]
    rows = df.toDF(*(f"v{i}" for i in range(len(types))))
    return df.sparkSession.sql(stats._likely_modes_sql(types), rows=rows).first()[0]


def plain_mode(items):
    counts = Counter(i for i in items if i is not None)
    return min(counts, key=lambda v: (-counts[v], v)) if counts else None


def test_modes_of_skewed_columns_are_proven(spark):
    """Many distinct values, one or two of which are frequent: only these are counted."""
    rng = random.Random(5)
    n = 60_000
    hot = [7 if rng.random() < 0.3 else rng.randrange(1 << 40) for _ in range(n)]
    two = ["b" if rng.random() < 0.02 else "a" if rng.random() < 0.02 else f"x{rng.random()}" for _ in range(n)]
    near = [rng.choice([0.0, -0.0, 1.5]) if rng.random() < 0.5 else rng.random() for _ in range(n)]
    nulls = [None if rng.random() < 0.9 else rng.randrange(3) for _ in range(n)]
    df = spark.createDataFrame(
        list(zip(hot, two, near, nulls, strict=True)), "hot bigint, two string, near double, nulls int"
    ).repartition(9)
    found = likely_modes(df)
    assert all(k and len(k) <= 4 for k in found)
    modes = {r.at: r.mode for r in stats.modes_of(df, df.columns).collect()}
    assert modes == {0: "7", 1: plain_mode(two), 2: "0.0", 3: str(plain_mode(nulls))}
    for name, items in zip(df.columns, (hot, two, near, nulls), strict=True):
        assert spark.range(1).select(stats.mode_of(df, name)).first()[0] == plain_mode(items)


def test_modes_that_cannot_be_proven_are_counted_in_full(spark):
    rng = random.Random(6)
    even = [rng.randrange(20_000) for _ in range(40_000)]
    unique = list(range(40_000))
    df = spark.createDataFrame(
        [(a, b, [a % 3]) for a, b in zip(even, unique, strict=True)], "even int, one bigint, some array<int>"
    ).repartition(5)
    assert list(likely_modes(df)) == [None] * 3
    assert spark.sql(
        f"SELECT ({stats._likely_modes_sql([T.LongType()])}) AS k", rows=df.where("one < 0").selectExpr("one AS v0")
    ).first().k is None
    modes = {r.at: r.mode for r in stats.modes_of(df, df.columns).collect()}
    some = [a % 3 for a in even]
    assert modes == {0: str(plain_mode(even)), 1: "0", 2: f"[{plain_mode(some)}]"}
    assert spark.range(1).select(stats.mode_of(df, "even")).first()[0] == plain_mode(even)


def test_modes_of_other_types(spark):
    rows = [(i % 3 == 0, Decimal(i % 2), str(i % 4).encode(), date(2020, 1, 1 + i % 5), None) for i in range(60)]
    df = spark.createDataFrame(rows, "a boolean, b decimal(30,2), c binary, d date, e float")
    modes = {r.at: r.mode for r in stats.modes_of(df, df.columns).collect()}
    assert modes == {0: "false", 1: "0.00", 2: "0", 3: "2020-01-01"}
    nothing = df.where("a IS NULL")
    assert stats.modes_of(nothing, df.columns).collect() == []
    assert spark.range(1).select(stats.mode_of(nothing, "c")).first()[0] is None


def test_approximate_median(spark):
    df = spark.range(0, 100_001, numPartitions=300).select(
        F.when(F.col("id") != 7, F.col("id")).alias("v")
    )
    filled = fill.fill_median(df, "v", approx=True)
    assert filled.where("v between 49500 and 50500").count() == 1002
    empty = frame(spark, [None, NAN])
    assert values(fill.fill_median(empty, "v", approx=True)) == [None, None]
    two = frame(spark, [Decimal("1.5"), None], "decimal(5,1)")
    assert values(fill.fill_median(two, "v", approx=True)) == [Decimal("1.5"), Decimal("1.5")]


def test_fills_join_nothing(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    filled = fill.fill_mode(fill.fill_mean(df, "l_tax"), "l_returnflag")
    plan = filled._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan


def test_duplicates(spark):
    df = frame(spark, [NAN, NAN, None, 0.0, -0.0])
    assert remove_duplicates(df).count() == 2
    nested = spark.createDataFrame([([1],), ([1],)], "v array<int>")
    assert remove_duplicates(nested).count() == 1
    with pytest.raises(TypeError):
        remove_duplicates(spark.createDataFrame([({"a": 1},)], "v map<string,int>"))


def test_profile_tables(spark):
    df = spark.createDataFrame([(1, "a", NAN), (None, "b", 2.0)], "i int, s string, d double")
    assert {r["name"]: r["present"] for r in schema_table(df).collect()} == {"i": 1, "s": 2, "d": 1}
    assert schema_list(df)[0] == {"name": "i", "type": "int"}
    assert shape(df).first().asDict() == {"rows": 2, "columns": 3}
    assert shape(df.limit(0)).first().asDict() == {"rows": 0, "columns": 3}
    found = {r["column"]: r for r in profile_columns(df).collect()}
    assert found["d"]["mean"] == 2.0 and found["s"]["mode"] == "a" and found["i"]["missing"] == 1
    assert {r["column"] for r in fill_strategies(df).collect()} == {"i", "d"}


def test_profile_takes_as_many_scans_for_any_columns(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    for names in (["l_tax"], df.columns):
        assert scans(profile_columns(df, names)) == 6


def test_profile_of_many_types(spark):
    rows = [(1, "b", NAN, Decimal("2.50"), True, None), (3, "a", 2.0, None, True, None), (None, "b", 4.0, Decimal("1.00"), False, None)]
    df = spark.createDataFrame(rows, "i int, s string, d double, c decimal(30,2), b boolean, n bigint")
    found = {r["column"]: tuple(r)[1:] for r in profile_columns(df).collect()}
    assert found == {
        "i": (1, 2.0, 2.0, "1"),
        "s": (0, None, None, "b"),
        "d": (1, 3.0, 3.0, "2.0"),
        "c": (1, 1.75, 1.75, "1.00"),
        "b": (0, None, None, "true"),
        "n": (3, None, None, None),
    }
