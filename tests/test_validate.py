"""Rules, reports and the split."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkprep.operators import validate as v
from sparkprep.operators.validate import ColumnExists, NotNull, OfType, RowRule


def multiset(df):
    return sorted(map(repr, df.collect()))


def report(df, rules):
    return {r["rule"]: r.asDict() for r in v.validation_report(df, rules).collect()}


def test_report_of_present_and_absent_columns(spark):
    df = spark.createDataFrame([(1,), (2,), (None,), (4,)], "passenger_count int")
    rules = [
        ColumnExists("passenger_count"),
        ColumnExists("actions.video_view"),
        NotNull("passenger_count"),
        NotNull("actions.video_view"),
        OfType("passenger_count", "int"),
        OfType("passenger_count", "float"),
    ]
    found = report(df, rules)
    assert [found[r.name]["success"] for r in rules] == [True, False, False, False, True, False]
    assert found["not_null(passenger_count)"]["unexpected_count"] == 1
    assert found["not_null(passenger_count)"]["unexpected_percent"] == 25.0
    assert found["not_null(actions.video_view)"]["unexpected_count"] == 0
    assert v.split(df, rules)[1].count() == 1
    assert [r.column for r in v.admissible(df, rules)].count("actions.video_view") == 1


def test_report_of_an_empty_frame(spark):
    found = report(spark.createDataFrame([], "a int"), [NotNull("a")])
    assert found["not_null(a)"]["success"] is True
    assert found["not_null(a)"]["unexpected_percent"] == 0.0
    with pytest.raises(ValueError):
        v.validation_report(spark.range(1), [])


@pytest.mark.parametrize(
    "kind, good, bad",
    [
        ("int", ["1", "-2", "+3", "007"], ["1.0", "", " 1", "x", "1e3"]),
        ("float", ["1", "1.", ".5", "-1e-3", "2E+4"], [".", "e3", "1,5", "nan", ""]),
        ("boolean", ["true", "FALSE", "True"], ["yes", "1", ""]),
        (
            "datetime",
            ["2024-02-29", "2024-01-01 10:00", "2024-01-01T10:00:00.25"],
            ["2024-02-30", "2024", "2024-01-01 25:00", "01/02/2024", ""],
        ),
        ("string", ["", "x"], []),
    ],
)
def test_type_rules_on_text(spark, kind, good, bad):
    df = spark.createDataFrame([(t,) for t in good + bad + [None]], "t string")
    clean, error = v.split(df, [OfType("t", kind)])
    assert sorted(r["t"] for r in error.collect()) == sorted(bad)
    assert clean.count() == len(good) + 1


def test_all_pass_and_all_fail(spark):
    df = spark.createDataFrame([(1,), (2,)], "a int")
    clean, error = v.split(df, [NotNull("a"), ColumnExists("a")])
    assert (clean.count(), error.count()) == (2, 0)
    nulls = df.select(F.lit(None).cast("int").alias("a"))
    clean, error = v.split(nulls, [NotNull("a")])
    assert (clean.count(), error.count()) == (0, 2)
    assert v.split(df, [])[1].isEmpty()


def test_more_failures_than_a_sample_all_go_to_error(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 2 == 0, F.col("id")).alias("a"))
    assert v.split(df, [NotNull("a")])[1].count() == 500
    sample = v.unexpected_sample(df, [NotNull("a")], "id")
    assert [r["id"] for r in sample.orderBy("id").collect()] == list(range(1, 41, 2))


CELLS = st.tuples(
    st.one_of(st.none(), st.floats(allow_infinity=False), st.just(float("nan"))),
    st.one_of(st.none(), st.sampled_from(["1", "x", "", "2.5", "true", "2024-01-01"])),
)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(CELLS, max_size=8))
def test_clean_and_error_are_the_input(spark, rows):
    df = spark.createDataFrame(rows, "a double, t string")
    rules = [NotNull("a"), OfType("t", "float"), RowRule("a", "small", lambda d: F.col("a") > 10)]
    clean, error = v.split(df, rules)
    assert multiset(clean.unionByName(error)) == multiset(df)
    assert v.suite_success(v.validation_report(clean, rules)).first()["success"] is True
    marked = v.with_reasons(df, rules)
    assert marked.where(F.size("_failed") > 0).count() == error.count()


def test_reasons(spark):
    df = spark.createDataFrame([(None, "x"), (1, "x"), (1, "1")], "a int, t string")
    rules = [NotNull("a"), OfType("t", "int")]
    found = {r["rule"]: r["rows"] for r in v.error_reasons(df, rules).collect()}
    assert found == {"not_null(a)": 1, "of_type(t, int)": 2}
    assert v.split(df, rules[:1])[1].count() == 1
    assert v.error_reasons(df, [ColumnExists("a")]).isEmpty()
    assert v.error_reasons(df.where("a = 1 AND t = '1'"), rules).isEmpty()


def test_suite_forms():
    expected = [ColumnExists("video_view6"), NotNull("video_view6"), OfType("n", "int")]
    camel = [
        {"expectation_type": "ExpectColumnToExist", "kwargs": {"column": "video_view6"}},
        {"expectation_type": "ExpectColumnValuesToNotBeNull", "kwargs": {"column": "video_view6"}},
        {
            "expectation_type": "ExpectColumnValuesToBeOfType",
            "kwargs": {"column": "n"},
            "expected_type": "int",
        },
    ]
    nested = {"pipeline_name": "", "validation_config": {"suite": {"expectations": camel}}}
    assert v.suite_from_json(nested) == expected
    assert v.suite_from_json(json.dumps(camel)) == expected
    assert v.suite_from_json(v.suite_to_json(expected)) == expected
    by_name = {"ExpectColumnValuesToNotBeNull": "actions.video_view"}
    assert v.suite_from_dict(by_name) == [NotNull("actions.video_view")]
    many = {"expect_column_to_exist": ["a", "b"]}
    assert v.suite_from_dict(many) == [ColumnExists("a"), ColumnExists("b")]


@pytest.mark.parametrize(
    "entry",
    [
        {"expectation_type": "expect_something_else", "kwargs": {"column": "a"}},
        {"expectation_type": "expect_column_to_exist", "kwargs": {}},
        {"expectation_type": "expect_column_values_to_be_of_type", "kwargs": {"column": "a"}},
        {
            "expectation_type": "expect_column_values_to_be_of_type",
            "kwargs": {"column": "a", "type": "money"},
        },
    ],
)
def test_bad_suite_entries(entry):
    with pytest.raises(ValueError):
        v.rule_from_dict(entry)


def test_suite_without_a_list():
    with pytest.raises(ValueError):
        v.suite_from_json({"suite": {}})


def test_further_rules_can_be_registered(spark):
    v.register_rule(
        "expect_column_values_to_be_positive",
        lambda column, kwargs: RowRule(column, f"positive({column})", lambda d: F.col(column) <= 0),
    )
    rules = v.suite_from_dict({"ExpectColumnValuesToBePositive": "a"})
    df = spark.createDataFrame([(1,), (-1,), (None,)], "a int")
    assert v.split(df, rules)[1].count() == 1


def test_plans(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    clean = v.split(events, [NotNull("value"), NotNull("event_type")])[0]
    plan = clean._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(event_type)" in plan and "IsNotNull(value)" in plan
    sample = v.unexpected_sample(events, [NotNull("value"), NotNull("event_type")], "event_id")
    plan = sample._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and "WindowGroupLimit" in plan
    one = v.validation_report(events, [NotNull("value"), NotNull("event_type")])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
