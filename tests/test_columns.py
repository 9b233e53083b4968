"""Names, missing values and type families."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import types as T

from sparkprep.functions.columns import NA_TOKENS, canonicalize_nan, family, is_missing, normalize_na
from sparkprep.functions.naming import camel_case, check_names, distinct_header, snake_case
from sparkprep.operators import projections as p
from sparkprep.operators.filters import drop_missing, filter_equals, has_nulls, parse_filter

NAN = float("nan")


@pytest.mark.parametrize(
    "name, snake, camel",
    [
        ("CustomerName", "customer_name", "customerName"),
        ("customerID", "customer_id", "customerId"),
        ("HTTPServer2Port", "http_server2_port", "httpServer2Port"),
        ("Order Date", "order _date", "orderDate"),
        ("l_orderkey", "l_orderkey", "lOrderkey"),
        ("col1a", "col1a", "col1A"),
        ("actions.video_view", "actions.video_view", "actions.VideoView"),
        ("_", "_", ""),
    ],
)
def test_conventions(name, snake, camel):
    assert snake_case(name) == snake
    assert camel_case(name) == camel


@given(st.text("aAbB1_ .", max_size=12))
def test_snake_case_is_stable(name):
    assert snake_case(snake_case(name)) == snake_case(name)
    assert snake_case(name).replace("_", "") == name.lower().replace("_", "")


def test_names_are_checked():
    with pytest.raises(ValueError):
        check_names(["a", ""])
    with pytest.raises(ValueError):
        check_names(["a", "a"])
    assert distinct_header(["a", "a", None, "a"]) == ["a", "a.1", "Unnamed: 2", "a.2"]


def test_empty_name_after_rename_is_rejected(spark):
    with pytest.raises(ValueError):
        p.apply_convention(spark.range(1).toDF("_"), "to_camel_case")


def test_renames_in_sequence_and_case(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    swapped = p.rename_column(p.rename_column(p.rename_column(df, "a", "t"), "b", "a"), "t", "b")
    assert swapped.columns == ["b", "a"]
    assert swapped.first().asDict() == {"b": 1, "a": 2}
    assert p.rename_column(df, "A", "x").columns == ["a", "b"]
    clash = df.toDF("B", "b")
    assert p.drop_columns(clash, ["B"]).first().asDict() == {"b": 2}
    assert p.rename_column(clash, "B", "c").first().asDict() == {"c": 1, "b": 2}
    with pytest.raises(ValueError):
        p.apply_convention(clash, "to_lowercase")


def test_dotted_and_padded_names(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "`actions.video_view` int, ` x ` string")
    assert drop_missing(df, [" x "]).count() == 1
    assert p.apply_convention(df, "trim_spaces").columns == ["actions.video_view", "x"]
    assert p.drop_columns(df, ["actions.video_view"]).columns == [" x "]
    assert p.drop_column_if_null(df, " x ").columns == ["actions.video_view"]
    assert p.drop_column_if_null(df, "actions.video_view").columns == df.columns
    assert p.drop_column_if_null(df, "absent").columns == df.columns


def test_missing_is_null_or_nan(spark):
    df = spark.createDataFrame([(1.0,), (NAN,), (None,), (4.0,)], "v double")
    assert df.where(is_missing(df, "v")).count() == 2
    assert canonicalize_nan(df).where("v is null").count() == 2
    assert drop_missing(df).count() == 2
    assert has_nulls(df).first()["v"] is True
    assert has_nulls(df.limit(0)).first()["v"] is False


def test_na_tokens(spark):
    rows = [(t, t) for t in NA_TOKENS] + [("x", "NA"), ("0", "n/a"), (None, None)]
    df = spark.createDataFrame(rows, "a string, b string")
    assert len(NA_TOKENS) == 19
    assert normalize_na(df).where("a is not null").count() == 2
    assert normalize_na(df, ["a"]).where("b is null").count() == 1


def test_drop_missing_modes(spark):
    df = spark.createDataFrame([(1, None), (None, None), (1, 2)], "a int, b int")
    assert drop_missing(df).count() == 1
    assert drop_missing(df, how="all").count() == 2
    assert drop_missing(df, ["a", "absent"]).count() == 2
    assert drop_missing(df, ["absent"]).count() == 3
    with pytest.raises(ValueError):
        drop_missing(df, how="some")


def test_filter_equals_reads_the_literal_as_the_column_type(spark):
    df = spark.createDataFrame([(1, "1", True), (2, "x", False)], "i int, s string, b boolean")
    assert filter_equals(df, "i", "1").count() == 1
    assert filter_equals(df, "i", "x").count() == 0
    assert filter_equals(df, "s", "x").count() == 1
    assert filter_equals(df, "b", "true").count() == 1
    assert filter_equals(df, "absent", "x").count() == 2
    assert parse_filter("a:b:c") == ("a", "b:c")
    with pytest.raises(ValueError):
        parse_filter("a")


def test_families():
    assert family(T.DecimalType(10, 2)) == "float"
    assert family(T.ShortType()) == "int"
    assert family(T.BooleanType()) == "boolean"
    assert family(T.TimestampNTZType()) == "datetime"
    assert family(T.ArrayType(T.StringType())) == "other"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_null_checks_reach_the_scan(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = _plan(drop_missing(orders, ["o_orderstatus", "o_custkey"]).select("o_orderkey"))
    assert "IsNotNull(o_orderstatus)" in plan and "IsNotNull(o_custkey)" in plan
    assert "o_totalprice" not in plan
    renamed = p.apply_convention(orders, "to_uppercase")
    assert "IsNotNull(o_orderstatus)" in _plan(drop_missing(renamed, ["O_ORDERSTATUS"]))
    assert "EqualTo(o_custkey,7)" in _plan(filter_equals(orders, "o_custkey", "7"))


def test_renames_and_drops_are_one_projection(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    df = p.drop_columns(p.rename_column(orders, "o_custkey", "c"), ["o_totalprice"])
    df = p.apply_convention(df, "to_uppercase")
    assert _plan(df).count("Project") == 1
    assert df.columns[1] == "C"
