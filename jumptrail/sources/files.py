"""Files of exported containers as pieces of text, so that no file can vanish without a row.

Tasks list the folders and open the files, so the driver holds no list of them, however many there are; only in a
store that tasks cannot open themselves does Spark's own file source list and read them. A task reads its files block
by block, see `cutting`, so neither a long file nor a long document is ever one value.
"""

from __future__ import annotations

import io
import os
import sys
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jumptrail.shared import few_rows, no_rows, written
from jumptrail.sources import cutting
from jumptrail.sources.named import file_system

# Layout only: up to this many bytes a file is held by the task that reads it, a longer one is opened again.
WHOLE = cutting.BLOCK

# The UDF carries this module along, so workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A folder, names of files, or files that have been listed.
Paths = str | Sequence[str] | DataFrame

LISTED = "path string, location string, length bigint, modified timestamp"
_LISTED = pa.schema([("path", pa.string()), ("location", pa.string()), ("length", pa.int64()), ("modified", pa.timestamp("us", "UTC"))])
_FOUND = _LISTED.append(pa.field("folder", pa.bool_()))

READ = "path string, name string, length bigint, modified timestamp, digest string, " + cutting.PIECE
_READ = pa.schema(
    [
        ("path", pa.string()), ("name", pa.string()), ("length", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("digest", pa.string()),
        ("part", pa.int32()), ("before", pa.int64()), ("opening", pa.string()), ("text", pa.string()), ("reason", pa.string()),
    ]
)

# Layout only: a file of a listing names about so many bytes and at most so many files, and a batch holds so many bytes.
PART_BYTES, PART_FILES = 32 << 20, 2000
_BATCH_BYTES = 4 << 20

# What a URI's path holds as it is.
_URI = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_.!~*'():@&=+$,;/")


def escaped_path(path: str) -> str:
    """A file's path in which no character stands for others."""
    return "".join("\\" + c if c in "\\*?[]{}" else c for c in path)


def load(reader, paths: Paths) -> DataFrame:
    """Everything below a folder, or the named files."""
    reader = reader.option("recursiveFileLookup", "true")
    return reader.load(paths) if isinstance(paths, str) else reader.load([escaped_path(path) for path in paths])


def _named(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(path) of every file that a reader found, also of empty ones, which Spark's scans leave out.

    The names are in the driver's JVM already, as Spark lists files there; they do not pass through Python.
    """
    names = Column(spark._jvm.org.apache.spark.sql.functions.lit(files._jdf.inputFiles()))
    return spark.range(1).select(F.explode(names).alias("path")).select(_same_form(F.col("path")).alias("path"))


def _same_form(path: Column) -> Column:
    """A path whose scheme is followed by one slash, or by a name."""
    return F.regexp_replace(path, "^([A-Za-z][A-Za-z0-9+.-]*):///", "$1:/")


def empty_files(spark: SparkSession, paths: Paths) -> DataFrame:
    """(path) of the files without a byte."""
    files = load(spark.read.format("binaryFile"), paths)
    return _named(spark, files).join(files.select(file_path().alias("path")), "path", "left_anti")


def file_path() -> Column:
    """The file that a row comes from."""
    return _same_form(F.col("_metadata.file_path"))


def unescaped(path: Column) -> Column:
    """A path or name with the escapes of a URI undone."""
    return F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def file_name() -> Column:
    """The name of the file that a row comes from."""
    return unescaped(F.col("_metadata.file_name"))


def listed_by_source(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """What `listed` gives, from Spark's own file source, whose list is held by the driver."""
    files = load(spark.read.format("binaryFile"), paths)
    found = files.select(
        file_path().alias("path"), F.col("path").alias("location"), "length", F.col("modificationTime").alias("modified")
    )
    empty = empty_files(spark, paths).select(
        "path", unescaped(F.col("path")).alias("location"), F.lit(0).cast("bigint").alias("length"), F.lit(None).cast("timestamp").alias("modified")
    )
    return found.unionByName(empty)


def _split(location: str) -> tuple[str, str]:
    """What names a store, and the path in it."""
    scheme, _, rest = location.partition(":")
    if not rest.startswith("//"):
        return f"{scheme}:", rest
    authority, slash, path = rest[2:].partition("/")
    return f"{scheme}://{authority}", slash + path


def _opens(location: str) -> bool:
    """Whether a task can open the store by itself."""
    store, _ = _split(location)
    try:
        return store == "file:" or file_system(f"{store}/") is not None
    except (OSError, ValueError, ImportError):
        return False


def _in_store(location: str):
    """The file system of a location, and the location in it."""
    store, path = _split(location)
    if store == "file:":
        return file_system(path)
    system, root = file_system(f"{store}/")
    return system, root.rstrip("/") + path


def _as_uri(location: str) -> str:
    """A location as Spark writes the path of a file: a URI."""

    def kept(c: str) -> bool:
        return c in _URI or (c > "\x7f" and unicodedata.category(c)[0] != "Z" and unicodedata.category(c) != "Cc")

    store, path = _split(location)
    return store + "".join(c if kept(c) else "".join(f"%{byte:02X}" for byte in c.encode()) for c in path)


def _hidden(name: str) -> bool:
    """What Spark's file sources leave out."""
    return (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")


def _children(location: str) -> Iterator[tuple[str, bool, int, int]]:
    """(location, folder, length, milliseconds) of what lies in a folder, or of the file itself."""
    from pyarrow import fs

    system, path = _in_store(location)
    if isinstance(system, fs.LocalFileSystem) and os.path.isdir(path):
        with os.scandir(path) as found:
            for one in found:
                if not _hidden(one.name):
                    status = one.stat()
                    yield f"{location.rstrip('/')}/{one.name}", one.is_dir(), status.st_size, status.st_mtime_ns // 1_000_000
        return
    own = system.get_file_info(path)
    for one in [own] if own.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path)):
        if one is own or not _hidden(one.base_name):
            folder = one.type == fs.FileType.Directory
            where = location if one is own else f"{location.rstrip('/')}/{one.base_name}"
            yield where, folder, 0 if folder else one.size, (one.mtime_ns or 0) // 1_000_000


def _look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What lies in folders; an empty file has no time."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows), _FOUND)], schema=_FOUND)

    rows: list[tuple] = []
    for folders in batches:
        for folder in folders.column(0).to_pylist():
            for location, is_folder, length, millis in _children(folder):
                time = datetime.fromtimestamp(millis // 1000, timezone.utc).replace(microsecond=millis % 1000 * 1000) if length else None
                rows.append((_as_uri(location), location, length, time, is_folder))
                if len(rows) == 10_000:
                    yield batch(rows)
                    rows = []
    if rows:
        yield batch(rows)


def _roots(spark: SparkSession, paths: str | Sequence[str]) -> list[str]:
    """Full names of a folder, of what its wildcards stand for, or of the named files; none if one is not there."""
    found = []
    for path in [paths] if isinstance(paths, str) else [escaped_path(path) for path in paths]:
        name = spark._jvm.org.apache.hadoop.fs.Path(path)
        there = name.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(name)
        if not there:
            return []
        found += [status.getPath().toString() for status in there]
    return found


def listed(spark: SparkSession, paths: Paths) -> DataFrame:
    """(path, location, length, modified) of every file as a written table; contents are not read. A location is what
    `load` takes.

    Folders are listed by tasks, one level of them after the other. An empty file has no time.
    """
    if isinstance(paths, DataFrame):
        return paths
    roots = _roots(spark, paths)
    if not roots or not all(map(_opens, roots)):
        # This also says what is missing.
        return written(listed_by_source(spark, paths), "listed") if paths else no_rows(spark, LISTED)
    folders = few_rows(spark, "location string", location=roots)
    levels = []
    while True:
        level = written(folders.mapInArrow(_look, LISTED + ", folder boolean"), "level")
        levels.append(level.filter("NOT folder").drop("folder"))
        folders = level.filter("folder").select("location")
        if folders.isEmpty():
            break
        folders = folders.repartition("location")
    files = levels[0]
    for level in levels[1:]:
        files = files.unionByName(level)
    return written(spread(files), "listed")


def spread(files: DataFrame) -> DataFrame:
    """A listing in so many partitions that no task has to read many files or bytes."""
    number, size = files.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    parts = max(size // PART_BYTES, number // PART_FILES, min(number, files.sparkSession.sparkContext.defaultParallelism), 1)
    return files.repartition(int(parts))


def _read(skip_gone: bool, cut: Callable[[cutting.Text], Iterator[cutting.Piece]]):
    """Rows of a listing as pieces of each file, by tasks that open it unless the rows hold its bytes."""

    def opener(row: dict) -> Callable:
        if "content" in row:
            return lambda: io.BytesIO(row["content"])
        system, path = _in_store(row["location"])
        return lambda: system.open_input_stream(path)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for listing in batches:
            for number in range(listing.num_rows):
                row = listing.slice(number, 1).to_pylist()[0]
                name = row["location"].rpartition("/")[2]
                begun = False
                try:
                    text = cutting.Text(opener(row), WHOLE)
                    for piece in cut(text):
                        begun = True
                        yield row["path"], name, text.length, row["modified"], text.digest, *piece
                except FileNotFoundError:
                    if begun or not skip_gone:
                        raise

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*held), _READ)], schema=_READ)

        for row in pieces(batches):
            held.append(row)
            size += len(row[-2] or "")
            if size >= _BATCH_BYTES or len(held) == 1000:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()

    return read


def whole_files(
    spark: SparkSession, paths: Paths, skip_gone: bool = False, cut: Callable[[cutting.Text], Iterator[cutting.Piece]] = cutting.containers
) -> DataFrame:
    """(path, name, length, modified, digest, part, before, opening, text, reason): the pieces that `cut` makes of each file.

    A file that went away since it was listed is an error, or left out.
    """
    files = listed(spark, paths).select("path", "location", "length", "modified")
    some = files.select("location").first()
    if some is not None and not _opens(some["location"]):
        reader = spark.read.format("binaryFile").option("ignoreMissingFiles", str(skip_gone).lower())
        source = paths if not isinstance(paths, DataFrame) else [r["location"] for r in files.select("location").collect()]
        bytes_of = load(reader, source).select(file_path().alias("path"), "content")
        # Spark's scans leave out files without a byte.
        files = files.join(bytes_of, "path", "left").withColumn("content", F.when(F.col("length") == 0, F.lit(b"")).otherwise(F.col("content")))
        files = files.filter("content IS NOT NULL")
    return files.mapInArrow(_read(skip_gone, cut), READ)
