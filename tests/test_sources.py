"""Reading, writing and loading each file once."""

import json
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import types as T

from sparkprep.functions import statistics
from sparkprep.operators.validate import ColumnExists, NotNull, OfType
from sparkprep.plans import cleaning, steps
from sparkprep.session import new_path, work_dir
from sparkprep.sources import catalog, ledger, readers, sinks
from sparkprep.streaming import ingest

FOLDER = "/root/testdata/sf0.001"


def text(tmp_path, content, name="f.csv"):
    path = tmp_path / name
    path.write_text(content)
    return str(path)


def test_csv_types_and_missing_texts(spark, tmp_path):
    path = text(tmp_path, 'i,f,b,s,d\n1,1.5,true,"x, ""y""",2024-01-01\nNA,,null, z ,n/a\n')
    df = readers.read_csv(spark, path)
    assert [t for _, t in df.dtypes] == ["bigint", "double", "boolean", "string", "string"]
    assert [tuple(r) for r in df.collect()] == [
        (1, 1.5, True, 'x, "y"', "2024-01-01"),
        (None, None, None, " z ", None),
    ]
    raw = readers.read_csv(spark, path, na=False, infer=False)
    assert raw.collect()[1]["i"] == "NA"


def test_csv_with_a_schema(spark, tmp_path):
    schema = T.StructType.fromDDL("i int, d date")
    path = text(tmp_path, "a;b\n1;2024-02-29\nNA;\n")
    df = readers.read_csv(spark, path, delimiter=";", schema=schema)
    assert df.schema == schema and df.count() == 2
    with pytest.raises(ValueError):
        readers.read_csv(spark, text(tmp_path, "a,b\n1,2\n"), schema=T.StructType.fromDDL("i int"))
    bad = readers.read_csv(spark, text(tmp_path, "a\nx\n"), schema=T.StructType.fromDDL("a int"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        bad.collect()


def test_csv_headers(spark, tmp_path):
    assert readers.read_csv(spark, text(tmp_path, "a,a\n1,2\n")).columns == ["a", "a.1"]
    df = readers.read_csv(spark, text(tmp_path, "1,2\n3,4\n"), header=False)
    assert df.columns == ["0", "1"] and df.count() == 2
    clash = readers.read_csv(spark, text(tmp_path, "B,b\n1,x\nNA,y\n"))
    assert [tuple(r) for r in clash.collect()] == [(1, "x"), (None, "y")]
    assert clash.columns == ["B", "b"]
    with pytest.raises(ValueError):
        readers.read_csv(spark, text(tmp_path, ""))


def test_csv_whole_numbers_too_long_for_bigint(spark, tmp_path):
    df = readers.read_csv(spark, text(tmp_path, "a,b\n99999999999999999999,1\n1,2\n"))
    assert [t for _, t in df.dtypes] == ["double", "bigint"]


def test_csv_line_breaks_in_quotes(spark, tmp_path):
    path = text(tmp_path, 'a,b\n"x\ny",1\n')
    assert readers.read_csv(spark, path, multi_line=True).first()["a"] == "x\ny"


def test_json(spark, tmp_path):
    array = text(tmp_path, '[{"a": 1, "b": "x"},\n {"a": 2, "b": null}]', "a.json")
    assert readers.read_json(spark, array).count() == 2
    lines = text(tmp_path, '{"a": 1}\n{"a": 2}\n', "l.json")
    assert readers.read_json(spark, lines, lines=True).agg({"a": "sum"}).first()[0] == 3


def test_read_file_by_options(spark, tmp_path):
    csv = text(tmp_path, "1|2\n", "x.csv")
    options = {"format": "CSV", "header": False, "delimiter": "|"}
    assert readers.read_file(spark, csv, options).columns == ["0", "1"]
    parquet = readers.read_file(spark, f"{FOLDER}/region.parquet", {"format": "PARQUET"})
    assert parquet.count() == 5
    with pytest.raises(ValueError):
        readers.read_file(spark, csv, {"format": "xlsx"})
    readers.register_format("lines", lambda spark, path, options: spark.read.text(path))
    assert readers.read_file(spark, csv, {"format": "LINES"}).first()["value"] == "1|2"


def test_table_names_are_not_pasted_into_sql(spark):
    spark.range(3).createOrReplaceTempView("three")
    assert readers.read_sql(spark, "three").count() == 3
    with pytest.raises(AnalysisException):
        readers.read_sql(spark, "three WHERE id = 1")


def test_listing(spark, tmp_path):
    text(tmp_path, "x", "a.csv")
    text(tmp_path, "x", "b.crc")
    text(tmp_path, "x", ".c.csv.crc")
    (tmp_path / "sub").mkdir()
    found = catalog.list_files(spark, str(tmp_path))
    assert [r["file_name"] for r in found.collect()] == ["a.csv"]
    assert found.first()["length"] == 1
    spark.range(1).createOrReplaceTempView("listed_view")
    assert catalog.list_tables(spark).where("name = 'listed_view' AND temporary").count() == 1
    sizes = catalog.table_sizes(spark, ["listed_view"]).first()
    assert (sizes["rows"], sizes["columns"]) == (1, 1)


def test_overwriting_the_source(spark):
    spark.range(10).write.mode("overwrite").saveAsTable("own")
    half = spark.table("own").where("id < 5")
    with pytest.raises(ValueError, match="while"):
        sinks.write_table(half, "own")
    sinks.overwrite_source_table(half, "own")
    assert spark.table("own").count() == 5


def test_results_must_have_a_name_and_rows(spark):
    with pytest.raises(ValueError):
        sinks.load_result(spark.range(0), "t")
    with pytest.raises(ValueError):
        sinks.load_result(spark.range(1), "")
    with pytest.raises(ValueError):
        sinks.write_table(spark.range(1), "")
    sinks.load_result(spark.range(2), "loaded_result")
    assert spark.table("loaded_result").count() == 2


def test_split_in_one_pass(spark):
    df = spark.createDataFrame([(1, "x"), (None, "1")], "a int, t string")
    for rules, errors in (
        ([NotNull("a"), OfType("t", "int")], 2),
        ([NotNull("a")], 1),
        ([ColumnExists("a")], 0),
    ):
        path = new_path(spark, "split")
        sinks.write_split(df, rules, path)
        clean, error = sinks.read_split(spark, path)
        assert (clean.count(), error.count()) == (2 - errors, errors)
        assert clean.columns == df.columns


def test_sample(spark):
    path = new_path(spark, "sample")
    sinks.write_sample_csv(spark.range(100), path, order_by=["id"])
    assert [r["id"] for r in readers.read_csv(spark, path).collect()] == [0, 1, 2, 3, 4]


def test_schema_export(spark):
    path = new_path(spark, "schema")
    sinks.write_schema(spark.createDataFrame([(1, "x")], "a int, `b.c` string"), path)
    found = json.loads(spark.read.text(path).first()["value"])
    assert found == [{"name": "a", "type": "int"}, {"name": "b.c", "type": "string"}]


def test_each_file_is_loaded_once(spark, tmp_path):
    log, loads = new_path(spark, "ledger"), []
    for name in "abc":
        text(tmp_path, name, f"{name}.csv")

    def run(**options):
        return ledger.ingest_new_files(
            spark, str(tmp_path), log, loads.append, "*.csv", **options
        )

    assert run(batch_files=2) == 3
    assert [len(b) for b in loads] == [2, 1]
    assert run() == 0
    text(tmp_path, "other length", "a.csv")
    assert run() == 1 and Path(loads[-1][0]).name == "a.csv"
    assert run(force=True) == 3


def test_a_failed_load_is_repeated(spark, tmp_path):
    log = new_path(spark, "ledger")
    text(tmp_path, "x", "a.csv")

    def fail(paths):
        raise OSError("no")

    with pytest.raises(OSError):
        ledger.ingest_new_files(spark, str(tmp_path), log, fail)
    assert ledger.ingest_new_files(spark, str(tmp_path), log, lambda p: None) == 1


def test_stream_adds_only_new_files(spark, tmp_path):
    source, target, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    spark.range(5).write.parquet(source)
    schema = spark.range(1).schema
    run = lambda: ingest.ingest(ingest.file_stream(spark, source, schema), target, marks)
    run()
    run()
    assert spark.read.parquet(target).count() == 5
    spark.range(5, 7).write.mode("append").parquet(source)
    run()
    assert spark.read.parquet(target).count() == 7


def test_stream_steps_with_batch_statistics(spark, tmp_path):
    source, target, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    batch = spark.createDataFrame(
        [(1.0, "x", None), (3.0, None, 1), (None, "x", 2)], "v double, t string, i int"
    )
    batch.write.parquet(source)
    plan = [
        steps.FillNulls("v", "fill_median"),
        steps.FillNulls("t", "fill_mode"),
        steps.RemoveNulls("drop_column", column_to_drop="i"),
        steps.RenameColumns("to_uppercase", columns_to_transform="*"),
        steps.FillNulls("V", "fill_mean"),
        steps.FilterEquals("T", "x"),
    ]
    stream = ingest.file_stream(spark, source, batch.schema)
    ingest.ingest(cleaning.apply_steps(stream, plan, stats=batch), target, marks)
    found = sorted(tuple(r) for r in spark.read.parquet(target).collect())
    assert found == [(1.0, "x"), (2.0, "x"), (3.0, "x")]


def test_stream_reports_per_batch(spark, tmp_path):
    source, target, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    spark.createDataFrame([(1,), (None,)], "a int").coalesce(1).write.parquet(source)
    stream = ingest.file_stream(spark, source, T.StructType.fromDDL("a int"))
    ingest.report_batches(stream, [NotNull("a")], target, marks)
    row = spark.read.parquet(target).first()
    assert (row["batch_id"], row["element_count"], row["unexpected_count"]) == (0, 2, 1)


def test_the_session_names_the_shared_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert work_dir(spark) == named
    assert new_path(spark, "x").startswith(work_dir(spark))
    assert new_path(spark, "x") != new_path(spark, "x")
