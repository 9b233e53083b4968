"""Overwriting what is read, without losing rows whatever breaks off."""

import json
from itertools import combinations, permutations

import pytest
from pyspark.errors import PySparkException

from sparkprep.plans import job
from sparkprep.sources import replace, sinks


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


@pytest.fixture
def make(spark, tmp_path):
    """A table of 20 rows (id, k, p), partitioned by p if asked for, in a folder of its own."""
    made = iter(range(100))

    def build(partitioned=True, external=True, buckets=0, fmt="parquet", **options):
        name = f"replaced_{tmp_path.name}_{next(made)}".lower().replace("[", "_").replace("]", "_")
        frame = spark.range(20).selectExpr("id", "id * 2 AS k", "id % 3 AS p")
        writer = frame.write.format(fmt).options(**options)
        writer = writer.partitionBy("p") if partitioned else writer
        writer = writer.bucketBy(buckets, "k") if buckets else writer
        if external:
            writer = writer.option("path", str(tmp_path / name))
        writer.saveAsTable(name)
        spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('kept' = 'yes')")
        return name

    return build


def described(spark, name):
    text = spark.sql(f"DESCRIBE TABLE EXTENDED {name} AS JSON").first()[0]
    kept = "location", "type", "provider", "table_properties", "partition_columns", "num_buckets"
    return {k: v for k, v in json.loads(text).items() if k in kept}


def hidden(spark, name):
    files = replace.Files(spark, replace.table_info(spark, name).location)
    location = files.qualified(replace.table_info(spark, name).location)
    parent, _, last = location.rpartition("/")
    return [c for c in files.children(parent) if f"/.{last}." in c and not c.endswith(".crc")]


@pytest.mark.parametrize("external", [True, False])
@pytest.mark.parametrize("partitioned, buckets", [(True, 0), (False, 0), (False, 3), (True, 2)])
def test_table_from_itself(spark, make, external, partitioned, buckets):
    name = make(partitioned, external, buckets)
    before = described(spark, name)
    sinks.overwrite_source_table(spark.table(name).where("id < 8 AND p < 2"), name)
    wanted = [(i, 2 * i, i % 3) for i in range(8) if i % 3 < 2]
    assert rows(spark.table(name)) == wanted
    assert described(spark, name) == before
    location = replace.table_info(spark, name).location
    assert rows(spark.read.parquet(location).select("id", "k", "p")) == wanted
    if partitioned:
        assert spark.sql(f"SHOW PARTITIONS {name}").count() == 2
    sinks.overwrite_source_table(spark.read.parquet(location).where("id > 3"), name)
    assert rows(spark.table(name)) == [r for r in wanted if r[0] > 3]
    assert hidden(spark, name) == []


@pytest.mark.parametrize("external", [True, False])
def test_other_columns(spark, make, external):
    name = make(True, external)
    before = described(spark, name)
    changed = spark.table(name).selectExpr("p", "cast(id AS string) AS `Name.x`", "id + 0.5 AS d")
    sinks.overwrite_source_table(changed, name)
    assert spark.table(name).columns == ["Name.x", "d", "p"]
    assert spark.table(name).where("p = 1").count() == 7
    assert described(spark, name) == before


def test_without_rows(spark, make):
    for partitioned in (True, False):
        name = make(partitioned)
        sinks.overwrite_source_table(spark.table(name).where("id < 0"), name)
        assert rows(spark.table(name)) == []


def test_what_a_table_is_laid_out_by_must_stay(spark, make):
    name = make()
    with pytest.raises(ValueError, match="partitioned"):
        sinks.overwrite_source_table(spark.range(3).toDF("id"), name)
    with pytest.raises(PySparkException):
        sinks.overwrite_source_table(spark.range(3).selectExpr("id", "'x' AS p"), name)
    with pytest.raises(ValueError, match="buckets|bucketed"):
        sinks.overwrite_source_table(spark.range(3).toDF("id"), make(False, buckets=2))
    assert spark.table(name).count() == 20
    spark.range(1).createOrReplaceTempView("no_table")
    with pytest.raises(ValueError, match="not a table"):
        sinks.overwrite_source_table(spark.range(1), "no_table")


def test_result_that_fails(spark, make):
    for buckets in (0, 2):
        name = make(True, True, buckets)
        broken = spark.table(name).selectExpr(
            "id", "CASE WHEN id = 7 THEN raise_error('broken') ELSE k END AS k", "p"
        )
        with pytest.raises(PySparkException):
            sinks.overwrite_source_table(broken, name)
        assert spark.table(name).count() == 20 and hidden(spark, name) == []


class Stop(Exception):
    pass


@pytest.mark.parametrize("partitioned", [True, False])
@pytest.mark.parametrize("act", range(8))
def test_breaking_off_at_any_act(spark, make, monkeypatch, act, partitioned):
    """Whichever act is the last, all old or all new rows can be had, and a rerun finishes."""
    name = make(partitioned)
    location = replace.table_info(spark, name).location
    left = [act]

    def breaking(function):
        def run(*given):
            if not left[0]:
                raise Stop
            left[0] -= 1
            return function(*given)

        return run

    fresh = spark.table(name).selectExpr("id + 100 AS other", "p")
    with monkeypatch.context() as patch:
        for what in ("rename", "delete", "write"):
            patch.setattr(replace.Files, what, breaking(getattr(replace.Files, what)))
        patch.setattr(replace, "_tell_catalog", breaking(replace._tell_catalog))
        try:
            sinks.overwrite_source_table(fresh, name)
            done = True
        except Stop:
            done = False
    marked = replace.Files(spark, location).exists(replace.marker_of(location))
    if not marked and not done:
        # Nothing has happened yet.
        kept = spark.read.parquet(location).select("id", "p").collect()
        assert sorted(map(tuple, kept)) == [(i, i % 3) for i in range(20)]
    assert replace.finish_replacement(spark, location, sweep=True) == marked
    spark.catalog.refreshTable(name)
    if marked or done:
        assert rows(spark.table(name)) == [(i + 100, i % 3) for i in range(20)]
    else:
        assert sorted(r.id for r in spark.table(name).collect()) == list(range(20))
    assert hidden(spark, name) == []
    assert not replace.finish_replacement(spark, location)


def test_next_replacement_finishes_the_last(spark, make, monkeypatch):
    name = make()
    with monkeypatch.context() as patch:
        patch.setattr(replace, "_carry_out", lambda *given: None)
        sinks.overwrite_source_table(spark.table(name).where("id < 10"), name)
    assert spark.table(name).count() == 20
    location = replace.table_info(spark, name).location
    assert replace.finish_replacement(spark, location)
    sinks.overwrite_source_table(spark.table(name).where("id >= 5"), name)
    assert spark.table(name).count() == 5


def test_folder_from_itself(spark, tmp_path):
    path = str(tmp_path / "folder")
    spark.range(10).selectExpr("id", "id % 2 AS p").write.partitionBy("p").parquet(path)
    replace.replace_folder(spark.read.parquet(path).where("id < 6"), path, partition_by=["p"])
    assert rows(spark.read.parquet(path).where("p = 1").select("id")) == [(1,), (3,), (5,)]
    new = str(tmp_path / "new")
    replace.replace_folder(spark.range(3).toDF("a"), new, "csv", options={"header": "true"})
    assert spark.read.csv(new, header=True).count() == 3


def test_overwriting_refuses_to_delete_what_it_reads(spark, make):
    """A frame over the files of a table, not over the table."""
    for external in (True, False):
        name = make(False, external)
        location = replace.table_info(spark, name).location
        with pytest.raises(ValueError, match="while"):
            sinks.write_table(spark.read.parquet(location).where("id < 5"), name)
        with pytest.raises(ValueError, match="while"):
            sinks.load_file_to_table(spark, location, name, {"format": "PARQUET"})
        assert spark.table(name).count() == 20


TEXTS = ["", " x ", "  ", None, 'a "quote"', '"', '""', "comma, semicolon;", "\\", "\\\\N", "\t", "é日本", "null", "#x", "\u0001"]


@pytest.mark.parametrize("path", [True, False])
@pytest.mark.parametrize("single", [True, False])
def test_csv_tables_keep_text(spark, tmp_path, path, single):
    schema = "t string" if single else "t string, n int, u string"
    given = [(t,) if single else (t, i, t) for i, t in enumerate(TEXTS)]
    name = f"csv_text_{path}_{single}".lower()
    frame = spark.createDataFrame(given, schema)
    sinks.write_table(frame, name, "csv", path=str(tmp_path / "t") if path else None)
    assert rows(spark.table(name)) == sorted(given, key=repr)
    sinks.overwrite_source_table(spark.table(name).where("t IS NULL OR t <> 'null'"), name)
    assert rows(spark.table(name)) == sorted((g for g in given if g[0] != "null"), key=repr)
    spark.sql(f"DROP TABLE {name}")


def test_csv_tables_with_line_breaks(spark, tmp_path):
    given = [("a\nb", 1), ("\r\n", 2), ("c\rd", 3), (None, 4)]
    frame = spark.createDataFrame(given, "t string, n int")
    with pytest.raises(PySparkException, match="line break"):
        sinks.write_table(frame, "csv_breaks", "csv", path=str(tmp_path / "refused"))
    options = {"multiLine": "true", "lineSep": "\n"}
    sinks.write_table(frame, "csv_breaks", "csv", path=str(tmp_path / "t"), options=options)
    found = rows(spark.table("csv_breaks"))
    assert found == sorted(given, key=repr)
    with pytest.raises(PySparkException, match="stands for null"):
        sinks.write_table(spark.createDataFrame([("\\N",)], "t string"), "csv_null", "csv", path=str(tmp_path / "n"))


PLACES = ("source", "output_path", "split_path", "lineage_path")


@pytest.mark.parametrize("one, other", list(combinations(PLACES, 2)))
def test_places_of_a_job_lie_apart(spark, tmp_path, one, other):
    spark.range(10).write.parquet(str(tmp_path / "in"))

    def attempt(**places):
        at = {p: str(tmp_path / n) for p, n in zip(PLACES, ("in", "out", "split", "log"), strict=True)}
        at.update(places)
        spec = {
            "source": {"path": at.pop("source"), "format": "parquet"},
            "validation_config": {"expectations": [{"expectation_type": "expect_column_to_exist", "kwargs": {"column": "id"}}]},
            "output_table": f"apart_{one}_{other}",
            **at,
        }
        return job.run_job(spark, spec)

    for a, b in permutations((one, other)):
        at = str(tmp_path / "in") if a == "source" else str(tmp_path / "place")
        for below in ("", "/below"):
            places = {a: at, b: f"{at}{below}"} if b != "source" else {a: f"{tmp_path}/in{below}"}
            with pytest.raises(ValueError, match="while|both"):
                attempt(**places)
    assert spark.read.parquet(str(tmp_path / "in")).count() == 10
    attempt()
    assert spark.table(f"apart_{one}_{other}".lower()).count() == 10
    attempt()
    assert spark.read.parquet(str(tmp_path / "log")).count() == 6
    spark.sql(f"DROP TABLE apart_{one}_{other}")
