"""Training-order materialisation: token sequences on disk in the order in which they will be read.

Each task tokenizes its documents, strings their ids together (every document ends with its end-of-document id) and
cuts sequences of `length` tokens; only the last one of a task may be shorter. A sequence has the ordinal
task * 2**32 + its number in the task. A keyed Feistel network over the next even power of two, walked on until it
falls below the number of possible ordinals, permutes ordinals; the image is the sequence's place in the order. The
range of images is cut into equal ranges, one for each shard; a permutation spreads ordinals evenly, so shards are
even whatever the documents are. A shard is written by one task, sorted by image, as records of one stride:

    image (8 bytes), task (4), tokens that count (4), ids (2 bytes each, unused ones 0xFFFF), line feed

all little-endian. A record's place is its number times the stride, so reading can go on from any slot. The slot,
counted without gaps over all shards, is the shard's first slot plus the record's number.

Defined results: a null text is an empty document, only its end id; repeated rows are written each; an empty table
gives no shard and an empty index; other columns are ignored. Ids must be below 65535.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jumptrail.llm.text_arrays import mix
from jumptrail.llm.tokens import Encoder
from jumptrail.shared import fresh_path

LENGTH = 1024
KEY = 20_241
TASKS = 1_000_000  # more tasks than this are refused
ORDINALS = TASKS << 32
UNUSED = 0xFFFF
HEADER = 16
READ = 1000  # records of one read


def stride(length: int = LENGTH) -> int:
    """Bytes of a record."""
    return HEADER + 2 * length + 1


def feistel(value: np.ndarray, key: int, half: int, rounds: int = 6) -> np.ndarray:
    """A keyed permutation of the numbers below 2 ** (2 * half)."""
    mask = np.uint64((1 << half) - 1)
    left, right = value >> np.uint64(half), value & mask
    for number in range(rounds):
        salt = np.uint64((key * 0x9E3779B97F4A7C15 + number * 0xD1B54A32D192ED03) % (1 << 64))
        left, right = right, left ^ (mix(right ^ salt) & mask)
    return (left << np.uint64(half)) | right


def permute(ordinals: np.ndarray, size: int, key: int = KEY) -> np.ndarray:
    """A keyed permutation of the numbers below `size`: images outside are permuted again until they are inside."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    image = feistel(ordinals.astype(np.uint64), key, half)
    outside = np.flatnonzero(image >= size)
    while outside.size:
        image[outside] = feistel(image[outside], key, half)
        outside = outside[image[outside] >= size]
    return image


def records(docs: DataFrame, shards: int, length: int = LENGTH, key: int = KEY, path: str | None = None) -> DataFrame:
    """shard, place (the image) and record of every sequence."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        if task >= TASKS:
            raise ValueError(f"more than {TASKS} tasks")
        encoder, waiting, done = Encoder(path), array("H"), 0

        def made(final: bool) -> pa.RecordBatch:
            nonlocal waiting, done
            tokens = np.frombuffer(waiting, "<u2")
            whole = tokens.size // length
            rest = tokens[whole * length :]
            count = whole + bool(final and rest.size)
            body = np.full((count, length), UNUSED, "<u2")
            body[:whole] = tokens[: whole * length].reshape(whole, length)
            used = np.full(count, length, "<u4")
            if count > whole:
                body[whole, : rest.size] = rest
                used[whole] = rest.size
            ordinals = (np.uint64(task) << np.uint64(32)) + np.arange(done, done + count, dtype=np.uint64)
            places = permute(ordinals, ORDINALS, key)
            whole_records = np.empty((count, stride(length)), np.uint8)
            whole_records[:, :8] = places.astype("<u8").view(np.uint8).reshape(count, 8)
            whole_records[:, 8:12] = np.full(count, task, "<u4").view(np.uint8).reshape(count, 4)
            whole_records[:, 12:16] = used.view(np.uint8).reshape(count, 4)
            whole_records[:, 16:-1] = body.view(np.uint8).reshape(count, 2 * length)
            whole_records = whole_records[:, :-1]  # the line feed is written with the line
            done += count
            waiting = array("H", b"" if final else rest.tobytes())
            ends = np.arange(count + 1, dtype=np.int32) * (stride(length) - 1)
            binary = pa.Array.from_buffers(
                pa.binary(), count, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(whole_records).tobytes())]
            )
            shard = (places // np.uint64(-(-ORDINALS // shards))).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(shard), pa.array(places.astype(np.int64)), binary], ["shard", "place", "record"])

        for batch in batches:
            for ids in encoder.documents(batch.column(0)):
                waiting.extend(array("H", ids))
                if len(waiting) > 1000 * length:
                    yield made(final=False)
        yield made(final=True)

    return docs.select("text").mapInArrow(cut, "shard int, place long, record binary")


def materialise(
    docs: DataFrame, path: str, shards: int | None = None, length: int = LENGTH, key: int = KEY, tokenizer: str | None = None
) -> None:
    """Write the shards below `path`; as many as the session has shuffle partitions unless a number is given."""
    shards = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (
        records(docs, shards, length, key, tokenizer)
        .repartitionById(shards, F.col("shard"))
        .sortWithinPartitions("shard", "place")
        .select("shard", F.col("record").cast("string").alias("record"))
        .write.partitionBy("shard")
        .text(path)
    )


def files_below(spark: SparkSession, pattern: str) -> list:
    """Path and bytes of the files that match, in order of their names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(((one.getPath(), one.getLen()) for one in found or ()), key=lambda file: file[0].toString())


def read_index(spark: SparkSession, path: str, shards: int | None = None, length: int = LENGTH) -> DataFrame:
    """What the shards hold: slot, shard, byte offset in the shard, task, tokens that count, checksum of those ids."""
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    width = -(-ORDINALS // shards)

    def headers(rows: Iterator[bytes]) -> Iterator[tuple]:
        for row in rows:
            place, used = int.from_bytes(row[:8], "little"), int.from_bytes(row[12:16], "little")
            ids = row[HEADER : HEADER + 2 * used]
            yield place // width, place, int.from_bytes(row[8:12], "little"), used, zlib.crc32(ids)

    pattern = f"{path}/shard=*/*"
    rows = spark.sparkContext.binaryRecords(pattern, stride(length)).mapPartitions(headers) if files_below(spark, pattern) else []
    kept = spark.createDataFrame(rows, "shard int, place long, task int, n_tokens int, ids_crc32 long")
    sizes = kept.groupBy("shard").count()
    first = sizes.select(
        "shard",
        F.coalesce(
            F.sum("count").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("first"),
    )
    number = F.row_number().over(Window.partitionBy("shard").orderBy("place")) - 1
    return (
        kept.withColumn("number", number.cast("long"))
        .join(first, "shard")
        .select(
            (F.col("first") + F.col("number")).alias("slot"),
            "shard",
            (F.col("number") * stride(length)).alias("byte_offset"),
            "task",
            "n_tokens",
            "ids_crc32",
        )
    )


def read_from(spark: SparkSession, path: str, shard: int, number: int, length: int = LENGTH) -> Iterator[list[int]]:
    """Sequences of one shard in training order, from its record `number` on; what comes before is not read."""
    step = stride(length)
    for file, size in files_below(spark, f"{path}/shard={shard}/*"):
        if number * step >= size:
            number -= size // step
            continue
        stream = file.getFileSystem(spark._jsc.hadoopConfiguration()).open(file)
        try:
            stream.seek(number * step)
            while data := stream.readNBytes(READ * step):
                for at in range(0, len(data), step):
                    used = int.from_bytes(data[at + 12 : at + 16], "little")
                    yield np.frombuffer(data, "<u2", used, at + HEADER).tolist()
        finally:
            stream.close()
        number = 0


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents in training order and return the index of what was written."""
    path = fresh_path(spark, "training-order")
    materialise(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_index(spark, path)
