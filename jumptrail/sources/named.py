"""A sink that writes files under names of the rows' own choosing.

Rows are (name, content); rows of one name that follow each other in a partition become one file, streamed row by
row. A task writes below a hidden folder of its own and moves its files into place when it has written them all; a
failed task leaves nothing in place, and one that runs twice puts the same file there again. Names that a task wrote
go to a list in the folder, never through the driver; when the job fails, the lists say what to take away.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "named_files"
LISTS = "_written"
PENDING = "_temporary"

# Layout only: rows go to a task's Python in batches of about so many bytes, which it holds several times over.
BATCH = "4m"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

# The classes travel with the job, so workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def file_system(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """Where the names of a task's files are listed, and how many there are."""

    listing: str
    files: int


class NamedFilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = file_system(self.path)
        own = f"{PENDING}/{uuid.uuid4().hex}"
        names: list[str] = []
        stream = None
        try:
            for batch in iterator:
                for name, content in zip(batch.column(0), batch.column(1)):
                    if not names or names[-1] != name.as_py():
                        if stream:
                            stream.close()
                        names.append(name.as_py())
                        pending = f"{root}/{own}/{len(names)}"
                        system.create_dir(pending.rsplit("/", 1)[0], recursive=True)
                        stream = system.open_output_stream(pending)
                    stream.write(content.as_py() or b"")
            if stream:
                stream.close()
            listing = f"{root}/{LISTS}/{uuid.uuid4().hex}"
            system.create_dir(f"{root}/{LISTS}", recursive=True)
            with system.open_output_stream(listing) as out:
                out.write("\n".join(names).encode())
            for number, name in enumerate(names, 1):
                target = f"{root}/{name}"
                system.create_dir(target.rsplit("/", 1)[0], recursive=True)
                system.move(f"{root}/{own}/{number}", target)
        finally:
            if names:
                system.delete_dir(f"{root}/{own}")
        return Written(listing, len(names))

    def commit(self, messages: list[Written | None]) -> None:
        self._end()

    def abort(self, messages: list[Written | None]) -> None:
        """Take away what the tasks that ended have put in place."""
        system, root = file_system(self.path)
        for message in messages:
            if message is not None:
                with system.open_input_stream(message.listing) as names:
                    for name in filter(None, names.read().decode().split("\n")):
                        system.delete_file(f"{root}/{name}")
        self._end()

    def _end(self) -> None:
        from pyarrow import fs

        system, root = file_system(self.path)
        for folder in (LISTS, PENDING):
            if system.get_file_info(f"{root}/{folder}").type == fs.FileType.Directory:
                system.delete_dir(f"{root}/{folder}")


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> NamedFilesWriter:
        return NamedFilesWriter(self.options["path"])


def write_named(rows: DataFrame, path: str) -> None:
    """Write rows of name and content (binary), in their order; all rows of a name must be in one partition, together."""
    spark: SparkSession = rows.sparkSession
    spark.dataSource.register(NamedFiles)
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, BATCH)
    try:
        rows.select("name", "content").write.format(FORMAT).mode("append").save(path)
    finally:
        spark.conf.set(_BATCH, before)
