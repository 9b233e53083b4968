"""Replacing a table or folder by a result, also by one that reads it.

The result is written in full beside the target first. Only then is the target
moved away and the result moved to its place, by two renames on the same file
system. A marker beside them, written before the first rename and deleted after
the last act, says what is to be done; whatever breaks off in between is finished
by the next replacement of the same target, or by ``finish_replacement``. Until
the marker is there, nothing has happened to the target.

Between the two renames the target is away for a moment. Where renames are
copies, as on object stores, that takes as long as the copy. One writer per
target at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sparkprep.functions.columns import qcol

DEFAULT_FORMAT = "parquet"


class Files:
    """The file system that a path is on."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._jvm = spark._jvm
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._system = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._read = spark._jvm.org.apache.commons.io.IOUtils.toString

    def qualified(self, path: str) -> str:
        return self._system.makeQualified(self._path(path)).toString().rstrip("/")

    def exists(self, path: str) -> bool:
        return self._system.exists(self._path(path))

    def rename(self, old: str, new: str) -> None:
        if not self._system.rename(self._path(old), self._path(new)):
            raise OSError(f"{old} could not be renamed to {new}")

    def delete(self, path: str) -> None:
        self._system.delete(self._path(path), True)

    def write(self, path: str, text: str) -> None:
        """A file that is there in full or not at all."""
        draft = f"{path}.{uuid.uuid4().hex}"
        stream = self._system.create(self._path(draft), False)
        stream.write(text.encode())
        stream.close()
        self.rename(draft, path)

    def claim(self, path: str, text: str) -> bool:
        """Make a file with this text if there is none of the name; whether it was made.

        Of several that try at once, one makes it. (So it is where renaming to a
        file that is there is refused, which object stores may not do.)
        """
        draft = f"{path}.{uuid.uuid4().hex}"
        stream = self._system.create(self._path(draft), False)
        stream.write(text.encode())
        stream.close()
        if self._system.getScheme() == "file":
            # A rename would replace the file here; a link does not.
            names = [self._path(p).toUri().getPath() for p in (path, draft)]
            try:
                self._jvm.java.nio.file.Files.createLink(*(self._jvm.java.io.File(n).toPath() for n in names))
                made = True
            except Py4JJavaError as error:
                if "FileAlreadyExistsException" not in str(error.java_exception):
                    raise
                made = False
        else:
            try:
                made = self._system.rename(self._path(draft), self._path(path))
            except Py4JJavaError as error:
                if "AlreadyExists" not in str(error.java_exception):
                    raise
                made = False
        self.delete(draft)
        return made

    def make_folder(self, path: str) -> None:
        self._system.mkdirs(self._path(path))

    def read(self, path: str) -> str:
        stream = self._system.open(self._path(path))
        text = self._read(stream, "UTF-8")
        stream.close()
        return text

    def children(self, path: str) -> list[str]:
        return [s.getPath().toString() for s in self._system.listStatus(self._path(path))]


@dataclass(frozen=True)
class Swap:
    """What the marker says: ``fresh`` is complete and goes to ``target``, what is there to ``old``.

    For a table, its name and the schema of its rows without partition columns.
    """

    target: str
    fresh: str
    old: str
    table: str | None = None
    schema: str | None = None


@dataclass(frozen=True)
class TableInfo:
    """What the catalog says of a table's storage."""

    location: str
    provider: str
    options: Mapping[str, str]
    partition_by: tuple[str, ...]
    buckets: int
    bucket_by: tuple[str, ...]
    sort_by: tuple[str, ...]


def table_info(spark: SparkSession, name: str) -> TableInfo:
    text = spark.sql("DESCRIBE TABLE EXTENDED IDENTIFIER(:name) AS JSON", args={"name": name})
    found = json.loads(text.first()[0])
    if found.get("type") == "VIEW" or not found.get("location"):
        raise ValueError(f"{name} is not a table with files")
    return TableInfo(
        found["location"],
        found["provider"],
        found.get("storage_properties", {}),
        tuple(found.get("partition_columns", ())),
        int(found.get("num_buckets", 0)),
        tuple(found.get("bucket_columns", ())),
        tuple(found.get("sort_columns", ())),
    )


def _beside(path: str, kind: str) -> str:
    """A hidden name in the same folder, which readers of that folder pass over."""
    parent, _, name = path.rpartition("/")
    if not name or not parent or parent.endswith(":/"):
        raise ValueError(f"{path} has no folder beside it to write to")
    return f"{parent}/.{name}.{kind}"


def marker_of(path: str) -> str:
    return _beside(path, "swap")


def finish_replacement(spark: SparkSession, path: str, sweep: bool = False) -> bool:
    """Finish a replacement of the folder that broke off; whether there was one.

    With ``sweep``, also delete what replacements left that broke off while they
    wrote, which must not be under way any more.
    """
    files = Files(spark, path)
    path = files.qualified(path)
    marker = marker_of(path)
    found = files.exists(marker)
    if found:
        _carry_out(spark, files, Swap(**json.loads(files.read(marker))), marker)
    if sweep:
        left = tuple(_beside(path, kind).rpartition("/")[2] for kind in ("new-", "swap."))
        for child in files.children(path.rpartition("/")[0]):
            if child.rstrip("/").rpartition("/")[2].startswith(left):
                files.delete(child)
    return found


def _carry_out(spark: SparkSession, files: Files, swap: Swap, marker: str) -> None:
    """Every act can be repeated from any point at which it broke off."""
    if files.exists(swap.fresh):
        if files.exists(swap.target):
            if files.exists(swap.old):
                raise OSError(f"{swap.target} was written to while it was being replaced")
            files.rename(swap.target, swap.old)
        files.rename(swap.fresh, swap.target)
    if swap.table:
        _tell_catalog(spark, swap)
    else:
        spark.catalog.refreshByPath(swap.target)
    files.delete(swap.old)
    files.delete(marker)


def _tell_catalog(spark: SparkSession, swap: Swap) -> None:
    """Bring the catalog's columns and partitions of a table up to its files."""
    wanted = T.StructType.fromJson(json.loads(swap.schema))
    info = table_info(spark, swap.table)
    now = [f for f in spark.table(swap.table).schema.fields if f.name not in info.partition_by]
    if _shape(now) != _shape(wanted.fields):
        # ALTER TABLE cannot rename or drop columns of such tables; the catalog can.
        session = spark._jsparkSession
        name = session.sessionState().sqlParser().parseTableIdentifier(swap.table)
        table = session.sessionState().catalog().getTableMetadata(name).identifier()
        catalog = session.sharedState().externalCatalog()
        columns = session.parseDataType(swap.schema)
        catalog.alterTableDataSchema(table.database().get(), table.table(), columns)
    spark.catalog.refreshTable(swap.table)
    if info.partition_by:
        spark.sql("MSCK REPAIR TABLE IDENTIFIER(:name) SYNC PARTITIONS", args={"name": swap.table})
        spark.catalog.refreshTable(swap.table)


def _shape(fields: Sequence[T.StructField]) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in fields]


def _swap_in(spark: SparkSession, swap: Swap) -> None:
    files, marker = Files(spark, swap.target), marker_of(swap.target)
    files.write(marker, json.dumps(asdict(swap)))
    _carry_out(spark, files, swap, marker)


def replace_folder(
    df: DataFrame,
    path: str,
    fmt: str = DEFAULT_FORMAT,
    partition_by: Sequence[str] = (),
    options: Mapping[str, str] | None = None,
) -> None:
    """Replace the files of a folder by the frame, which may read that folder.

    A frame that cannot be computed leaves the folder as it was.
    """
    writer = df.write.format(fmt).options(**(options or {}))
    writer = writer.partitionBy(*partition_by) if partition_by else writer
    replace_by(df.sparkSession, path, writer.save)


def replace_by(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Replace a folder, if there is one, by what ``write`` puts into the folder it is given."""
    files = Files(spark, path)
    path = files.qualified(path)
    finish_replacement(spark, path)
    mark = uuid.uuid4().hex
    swap = Swap(path, _beside(path, f"new-{mark}"), _beside(path, f"old-{mark}"))
    _write(files, swap.fresh, write)
    _swap_in(spark, swap)


def _write(files: Files, path: str, write: Callable[[str], None]) -> None:
    """Write to a new folder; nothing is left of a failure."""
    try:
        write(path)
    except BaseException:
        files.delete(path)
        raise


def replace_table(df: DataFrame, name: str) -> None:
    """Replace the rows of a table by the frame, which may read the table or its files.

    The table stays what it is: its place, format and options, partitioning and
    buckets, properties, and whether the catalog owns its files. Columns may be
    others, but for those that it is partitioned by, which keep their type. A frame
    that cannot be computed leaves the table as it was.
    """
    spark = df.sparkSession
    info = table_info(spark, name)
    files = Files(spark, info.location)
    path = files.qualified(info.location)
    finish_replacement(spark, path)
    absent = [n for n in (*info.partition_by, *info.bucket_by, *info.sort_by) if n not in df.columns]
    if absent:
        raise ValueError(f"{name} is partitioned or bucketed by {', '.join(absent)}")
    before = spark.table(name).schema
    data = [f for f in df.schema.fields if f.name not in info.partition_by]
    # Read from files alone, partition columns may have come with another type.
    kept = [qcol(n).cast(before[n].dataType).alias(n) for n in info.partition_by]
    ordered = df.select([qcol(f.name) for f in data] + kept)
    mark = uuid.uuid4().hex
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in data]).json()
    swap = Swap(path, _beside(path, f"new-{mark}"), _beside(path, f"old-{mark}"), name, schema)
    writer = ordered.write.format(info.provider).options(**info.options)
    if info.partition_by:
        writer = writer.partitionBy(*info.partition_by)
    if not info.buckets:
        _write(files, swap.fresh, writer.save)
    else:
        # Buckets are written through the catalog only; a table of a moment, whose files stay.
        writer = writer.bucketBy(info.buckets, *info.bucket_by)
        writer = writer.sortBy(*info.sort_by) if info.sort_by else writer
        passing = f"replacing_{mark}"
        _write(files, swap.fresh, lambda at: writer.option("path", at).saveAsTable(passing))
        spark.sql(f"DROP TABLE {passing}")
    _swap_in(spark, swap)
