"""Nothing that is read gets lost: formats, splits, ledgers and jobs."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import types as T

from sparkprep.operators.validate import NotNull
from sparkprep.plans import job
from sparkprep.sources import ledger, readers, sinks


def write(path, text):
    path.write_text(text)
    return str(path)


def explained(df):
    execution = df._jdf.queryExecution()
    return df.sparkSession._jvm.PythonSQLUtils.explainString(execution, "simple")


def test_job_does_not_overwrite_its_source(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(100).write.parquet(source)
    for output in (source, f"file:{source}/", f"{source}/below", str(tmp_path)):
        spec = {
            "source": {"path": source, "format": "parquet"},
            "cleaning_config": {"cleaning_steps": [{"type": "remove_null_data", "strategy": "drop_rows_any"}]},
            "output_table": "lost",
            "output_path": output,
        }
        with pytest.raises(ValueError, match="source|while"):
            job.run_job(spark, json.dumps(spec))
    with pytest.raises(ValueError, match="while"):
        sinks.write_table(spark.read.parquet(source), "lost", path=source)
    assert spark.read.parquet(source).count() == 100


def test_job_does_not_overwrite_the_files_of_its_source_table(spark, tmp_path):
    spark.range(10).write.option("path", str(tmp_path / "t")).saveAsTable("by_path_source")
    spec = {
        "source": {"table": "by_path_source"},
        "output_table": "by_path_target",
        "output_path": str(tmp_path / "t"),
    }
    with pytest.raises(ValueError, match="while"):
        job.run_job(spark, spec)
    assert spark.table("by_path_source").count() == 10


def test_job_without_rows_leaves_its_output(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    target = str(tmp_path / "out")
    spec = {"source": {"path": str(tmp_path / "in"), "format": "parquet"}, "output_table": "kept_rows", "output_path": target}
    job.run_job(spark, spec)
    spec["transformations"] = [{"type": "Filter", "column": "id", "value": "99"}]
    with pytest.raises(ValueError, match="no data"):
        job.run_job(spark, spec)
    assert spark.table("kept_rows").count() == 5


def test_json_forms(spark, tmp_path):
    lines = write(tmp_path / "lines.json", "\n".join(f'{{"a": {i}}}' for i in range(10)))
    array = write(tmp_path / "array.json", "\n [\n" + ",\n".join(f'{{"a": {i}}}' for i in range(7)) + "]")
    spread = write(tmp_path / "spread.json", '{\n"a": 1\n}')
    assert readers.read_file(spark, lines, {"format": "JSON"}).count() == 10
    assert readers.read_file(spark, array, {"format": "json"}).count() == 7
    assert readers.read_file(spark, spread, {"format": "JSON", "lines": False}).count() == 1
    for path in (spread, str(tmp_path)):
        with pytest.raises(ValueError, match="lines"):
            readers.read_file(spark, path, {"format": "JSON"})


def test_json_forms_with_a_schema(spark, tmp_path):
    schema = T.StructType.fromDDL("a int, b string")
    first = write(tmp_path / "1.json", "\n" + "\n".join(f'{{"a": {i}}}' for i in range(50)))
    write(tmp_path / "2.json", '{"a": 1, "b": "x", "c": 2}\n\n{"b": null}\n')
    frame = readers.read_json(spark, str(tmp_path), schema)
    # Nothing is read ahead but the first line.
    assert explained(frame).count("FileScan") == 1
    assert frame.count() == 52 and frame.where("b = 'x'").count() == 1 and frame.columns == ["a", "b"]
    assert readers.read_json(spark, first, schema).count() == 50
    (tmp_path / "sub").mkdir()
    write(tmp_path / "sub" / "1.json", "\n".join(f'{{"a": {i}}}' for i in range(500)))
    write(tmp_path / "sub" / "2.json", '[\n{"a": 1},\n{"a": 2}]')
    # Whichever file is first.
    with pytest.raises(Exception, match="lines"):
        readers.read_json(spark, str(tmp_path / "sub"), schema).count()
    assert readers.read_json(spark, str(write(tmp_path / "sub" / "3.json", "")), schema).count() == 0


def test_csv_rows_of_a_wrong_width(spark, tmp_path):
    short = write(tmp_path / "short.csv", "a,b\n1\n2,3\n")
    wide = write(tmp_path / "wide.csv", "a,b\n1,2\n3,4,5\n")
    assert [tuple(r) for r in readers.read_csv(spark, short).collect()] == [(1, None), (2, 3)]
    with pytest.raises(PySparkException, match="more than 2 cells"):
        readers.read_csv(spark, wide).collect()


def test_csv_files_with_different_headers(spark, tmp_path):
    write(tmp_path / "1.csv", "a,b\n1,2\n")
    write(tmp_path / "2.csv", "b,a\n1,2\n")
    with pytest.raises(ValueError, match="different headers"):
        readers.read_csv(spark, str(tmp_path))
    write(tmp_path / "2.csv", "a,b\n3,4\n")
    assert sorted(map(tuple, readers.read_csv(spark, str(tmp_path)).collect())) == [(1, 2), (3, 4)]


def test_csv_headers_are_compared_in_the_scan(spark, tmp_path):
    """Quoted or not; with a schema nothing is read ahead but the first row."""
    write(tmp_path / "1.csv", "a,b c\n1,x\n")
    write(tmp_path / "2.csv", '"a","b c"\n2,\n')
    schema = T.StructType.fromDDL("n int, t string")
    frame = readers.read_csv(spark, str(tmp_path), schema=schema)
    assert explained(frame).count("FileScan csv") == 1
    assert sorted(map(tuple, frame.collect())) == [(1, "x"), (2, None)]
    assert frame.select("t").count() == 2 and frame.select("t").where("t = 'x'").count() == 1
    write(tmp_path / "3.csv", "a,c\n3,y\n")
    frame = readers.read_csv(spark, str(tmp_path), schema=schema)
    for read in (frame, frame.select("t")):
        with pytest.raises(Exception, match="header"):
            read.collect()
    # What is read is right in all files.
    assert sorted(r.n for r in frame.select("n").collect()) == [1, 2, 3]
    write(tmp_path / "3.csv", "a,b c,d\n3,y,z\n")
    with pytest.raises(Exception, match="header|columns"):
        readers.read_csv(spark, str(tmp_path), schema=schema).collect()


def test_csv_with_odd_headers_in_several_files(spark, tmp_path):
    for name in ("1", "2"):
        write(tmp_path / f"{name}.csv", f"B,b,,B\n{name},x,3,4\n")
    frame = readers.read_csv(spark, str(tmp_path))
    assert frame.columns == ["B", "b", "Unnamed: 2", "B.1"]
    assert sorted(map(tuple, frame.collect())) == [(1, "x", 3, 4), (2, "x", 3, 4)]


def test_csv_line_breaks_round_trip(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = [(1, 'a\n"b",\r\nc'), (2, None), (3, " x ")]
    df = spark.createDataFrame(rows, "i bigint, t string")
    with pytest.raises(PySparkException, match="line break"):
        sinks.write_csv(df, path)
    sinks.write_csv(df, path, multi_line=True)
    found = readers.read_csv(spark, path, schema=df.schema, multi_line=True)
    assert sorted(map(tuple, found.collect())) == rows


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
@pytest.mark.parametrize("values", [[1.0, 2.0], [None, None], [1.0, None], []])
def test_split_sides(spark, tmp_path, fmt, values):
    df = spark.createDataFrame([(i, v, "é,\"") for i, v in enumerate(values)], "i int, v double, t string")
    path = str(tmp_path / "split")
    sinks.write_split(df, [NotNull("v")], path, fmt)
    clean, error = sinks.read_split(spark, path, fmt)
    assert clean.schema == error.schema == df.schema
    both = sorted(clean.collect()), sorted(error.collect(), key=str)
    assert [r.v for r in both[0]] == [v for v in values if v is not None]
    assert len(both[1]) == sum(v is None for v in values)


def test_split_refuses_its_own_flag(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "_is_error int")
    with pytest.raises(ValueError, match="_is_error"):
        sinks.write_split(df, [], str(tmp_path / "split"))


@pytest.mark.parametrize("batch", [1, 2, 10])
def test_files_that_look_alike(spark, tmp_path, batch):
    for day in (1, 2, 3):
        (tmp_path / "in" / f"day={day}").mkdir(parents=True)
        (tmp_path / "in" / f"day={day}" / "x.txt").write_text(f"{day}")
    loaded = []
    for _ in range(2):
        ledger.ingest_new_files(
            spark, str(tmp_path / "in"), str(tmp_path / "log"), loaded.extend, batch_files=batch
        )
    assert sorted(p[-9] for p in loaded) == ["1", "2", "3"] or len(set(loaded)) == 3 == len(loaded)


def names_and_loads(spark, tmp_path, folder, files):
    """Loads one file after the other; what the ledger calls them and how many were loaded."""
    loads = []
    for file in files:
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text("x")
        loads.append(
            ledger.ingest_new_files(spark, folder, str(tmp_path / "log"), lambda paths: None)
        )
    return {r.file for r in ledger.listed(spark, folder).collect()}, loads


def test_files_below_a_root_folder(spark, tmp_path):
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mount.links.as.symlinks", "false")
    files = [tmp_path / "in" / f"day={day}" / "part-0" for day in (1, 2)]
    for file in files:
        file.parent.mkdir(parents=True)
        conf.set(f"fs.viewfs.mounttable.bucket.link./{file.parent.name}", file.parent.as_uri())
    names, loads = names_and_loads(spark, tmp_path, "viewfs://bucket/", files)
    assert names == {"day=1/part-0", "day=2/part-0"} and loads == [1, 1]


def test_files_below_a_path_that_recurs(spark, tmp_path):
    folder = tmp_path / "in"
    again = str(folder).lstrip("/")
    files = [folder / f"day={day}" / again / "part-0" for day in (1, 2)]
    names, loads = names_and_loads(spark, tmp_path, str(folder), files)
    assert names == {f"day={day}/{again}/part-0" for day in (1, 2)} and loads == [1, 1]
