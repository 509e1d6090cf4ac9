"""Upkeep of the recent-documents list from a stream of additions.

Every batch writes its own maxima to a folder. As soon as FAN folders have the same level they are merged to one of
the next level, so the folders grow with the logarithm of the batches. A manifest names the folders that count; each
is a new file, put in place by one rename, and the highest number is the current one. What a manifest no longer names
is deleted when the next one is in place, so a reader of the last but one still finds its folders, and what a crash
left over goes with it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from jumptrail.operators.activity import admissible_names, existing, latest
from jumptrail.shared import remove

FAN = 4
MANIFEST = "_manifest"


class Manifest:
    """The folders of a list with their levels, oldest first."""

    def __init__(self, spark: SparkSession, out_dir: str) -> None:
        self.spark, self.out_dir = spark, out_dir.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(f"{self.out_dir}/{MANIFEST}").getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        place = self.path(folder)
        return [status.getPath().getName() for status in self.files.listStatus(place)] if self.files.exists(place) else []

    def versions(self) -> list[int]:
        return sorted(int(name) for name in self._names(f"{self.out_dir}/{MANIFEST}") if name.isdigit())

    def folders(self, version: int | None = None) -> list[tuple[int, str]]:
        """(level, name) of the folders that count."""
        versions = self.versions()
        if not versions:
            return []
        stream = self.files.open(self.path(f"{self.out_dir}/{MANIFEST}/{versions[-1] if version is None else version}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [(level, name) for level, name in json.loads(text)]

    def commit(self, folders: list[tuple[int, str]]) -> None:
        """Make these the folders that count, then delete what neither they nor the manifest before name."""
        before = self.versions()
        version = before[-1] + 1 if before else 0
        pending = self.path(f"{self.out_dir}/{MANIFEST}/.{uuid.uuid4().hex}")
        stream = self.files.create(pending, True)
        stream.write(json.dumps(folders).encode())
        stream.close()
        if not self.files.rename(pending, self.path(f"{self.out_dir}/{MANIFEST}/{version}")):
            raise OSError(f"another writer of {self.out_dir} made manifest {version}")
        named = {name for _, name in folders} | {name for _, name in (self.folders(before[-1]) if before else [])}
        for name in self._names(self.out_dir):
            if name != MANIFEST and name not in named:
                remove(self.spark, f"{self.out_dir}/{name}")
        for old in before[:-1]:
            remove(self.spark, f"{self.out_dir}/{MANIFEST}/{old}")

    def read(self, folders: list[tuple[int, str]]) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.out_dir}/{name}" for _, name in folders))


def append(spark: SparkSession, maxima: DataFrame, out_dir: str) -> None:
    """Add maxima to the list, merging folders where enough of them have one level."""
    manifest = Manifest(spark, out_dir)
    folders = manifest.folders()

    def put(rows: DataFrame, level: int) -> tuple[int, str]:
        name = f"level={level}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{manifest.out_dir}/{name}")
        return level, name

    folders.append(put(maxima, 0))
    while len(folders) >= FAN and folders[-FAN][0] == folders[-1][0]:
        merged = latest(manifest.read(folders[-FAN:]))
        folders[-FAN:] = [put(merged, folders[-1][0] + 1)]
    manifest.commit(folders)


def stream_recents(
    adds: DataFrame, known_files: DataFrame, out_dir: str, checkpoint: str
) -> StreamingQuery:
    """Keep the last time of each admissible document of each AppID.

    A maximum of maxima is the maximum, so no state is held between batches, folders can be merged in any way, and a
    repeated batch changes nothing.
    """

    def write_batch(batch_adds: DataFrame, batch: int) -> None:
        # The lookup reads its input more than once.
        maxima = latest(admissible_names(batch_adds)).persist()
        append(batch_adds.sparkSession, existing(maxima, known_files), out_dir)
        maxima.unpersist()

    return (
        adds.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def recents(spark: SparkSession, out_dir: str) -> DataFrame:
    """Current list: (appid, path, last_modified)."""
    manifest = Manifest(spark, out_dir)
    return latest(manifest.read(manifest.folders()))
