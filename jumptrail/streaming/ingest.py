"""Incremental ingest of exported containers, new ones and those that were written again.

`note_changes` compares the files of a folder with a log of what was noted before and appends what is new, what has
another length or time, and what is gone. A stream reads the log; each batch reads the files it names and writes
their rows under its number, and last a row for every file: its content's digest, how many documents and rejects it
gave, and the batch that holds its rows. A file whose bytes did not change keeps its rows. The rows of a file are
those of its last batch, so a file written again replaces itself, and a batch that is repeated overwrites its own
folders and changes nothing.

A file rewritten with the same length within the same millisecond of its time is not seen.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.util import inheritable_thread_target

from jumptrail.operators.documents import container_parts, containers_of, entries_of, lnks_of, split_rejects
from jumptrail.shared import SMALL, fresh_path, no_rows, remove
from jumptrail.sources.files import listed, spread
from jumptrail.sources.xml import documents_of, read_pieces

ENTRIES = "entries"
LNKS = "lnks"
REJECTS = "rejects"
PARTS = "parts"
FILES = "files"
CHANGES = "changes"

CHANGE = "path string, location string, length bigint, modified timestamp, gone boolean, seq bigint"
FILE = (
    "path string, length bigint, modified timestamp, gone boolean, digest string, n_documents bigint, n_rejects bigint, "
    "held bigint, batch bigint"
)


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that may not have been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return no_rows(spark, schema)


def _last(rows: DataFrame, order: str) -> DataFrame:
    """Of the rows of each path the one with the largest number."""
    others = [name for name in rows.columns if name not in ("path", order)]
    last = rows.groupBy("path").agg(F.max(F.struct(order, *others)).alias("last"))
    return last.select("path", "last.*")


def note_changes(spark: SparkSession, in_dir: str, log_dir: str, files_per_batch: int = 10_000) -> None:
    """Append to the log the files that are new or changed since it was last written, and those that are gone."""
    log = _stored(spark, log_dir, CHANGE)
    seq = (log.agg(F.max("seq")).first()[0] or 0) + 1
    known = _last(log, "seq").filter("NOT gone").select(
        "path", F.col("location").alias("old"), F.col("length").alias("l"), F.col("modified").alias("m")
    )
    both = listed(spark, in_dir).join(known, "path", "full_outer")
    other = F.col("l").isNull() | (F.col("l") != F.col("length")) | ~F.col("m").eqNullSafe(F.col("modified"))
    gone = F.col("length").isNull()
    rows = both.filter(gone | other).select(
        "path", F.coalesce("location", "old").alias("location"), "length", "modified", gone.alias("gone"),
        F.lit(seq).cast("bigint").alias("seq"),
    )
    rows = rows.persist()
    number = rows.count()
    if number:
        # A file of the log is a batch of the stream.
        parts = rows.repartition(-(-number // files_per_batch))
        parts.write.mode("append").option("maxRecordsPerFile", files_per_batch).parquet(log_dir)
    elif not seq > 1:
        rows.write.mode("append").parquet(log_dir)
    rows.unpersist()


def _side_by_side(spark: SparkSession, *steps: Callable[[], None]) -> None:
    """Steps that do not wait for each other: of a batch each is a short job, and takes longer to plan than to run."""
    with ThreadPoolExecutor(len(steps)) as pool:
        for step in [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]:
            step.result()


def _write_batch(spark: SparkSession, out_dir: str, host: str) -> Callable[[DataFrame, int], None]:
    def write(changes: DataFrame, batch: int) -> None:
        def put(rows: DataFrame, table: str) -> None:
            rows.write.mode("overwrite").option("compression", SMALL).parquet(f"{out_dir}/{table}/batch={batch}")

        changes = _last(changes, "seq").persist()
        before = _stored(spark, f"{out_dir}/{FILES}", FILE).filter(F.col("batch") < batch)
        before = _last(before.join(F.broadcast(changes.select("path")), "path", "left_semi"), "batch")
        # Written once, as all the tables below read it; it goes when the batch is done.
        parsed = fresh_path(spark, "parsed")
        # What went away since it was noted is left out; the next look at the folder notes that.
        there = spread(changes.filter("NOT gone").select("path", "location", "length", "modified"))
        documents_of(read_pieces(spark, there, skip_gone=True), host).drop("raw").write.option("compression", SMALL).parquet(parsed)
        docs = spark.read.parquet(parsed)
        broken, begins = F.col("_corrupt_record").isNotNull(), F.col("part") == 0
        read = docs.groupBy(F.col("source").alias("path")).agg(
            F.max("digest").alias("digest"), F.count_if(~broken & begins).alias("n_documents"), F.count_if(broken & begins).alias("n_rejects")
        )
        same = ~F.col("gone") & F.col("digest").eqNullSafe(F.col("old")) & F.col("digest").isNotNull() & F.col("was").isNotNull()
        files = (
            changes.join(read, "path", "left")
            .join(before.select("path", F.col("digest").alias("old"), F.col("held").alias("was")), "path", "left")
            .select(
                "path", "length", "modified", "gone", "digest", F.coalesce("n_documents", F.lit(0)).alias("n_documents"),
                F.coalesce("n_rejects", F.lit(0)).alias("n_rejects"),
                F.when(same, F.col("was")).when(~F.col("gone"), F.lit(batch)).cast("bigint").alias("held"),
            )
        ).persist()
        files.count()
        new = F.broadcast(files.filter(F.col("held") == batch).select(F.col("path").alias("source")))
        docs_new = docs.join(new, "source", "left_semi")
        good, rejects = split_rejects(docs_new)
        _side_by_side(
            spark,
            lambda: put(entries_of(good, "source"), ENTRIES),
            lambda: put(lnks_of(good, "source"), LNKS),
            lambda: put(rejects, REJECTS),
            lambda: put(container_parts(docs_new, "source"), PARTS),
        )
        # Last, as the batch counts when its files are noted.
        put(files, FILES)
        for table in (changes, files):
            table.unpersist()
        remove(spark, parsed)

    return write


def stream_ingest(
    spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, files_per_batch: int = 10_000, host: str = ""
) -> StreamingQuery:
    """Bring the tables below `out_dir` to what the files of a folder hold now.

    Looks at the folder once; the stream then works through the log in batches of at most `files_per_batch` files and
    ends. A restart from the checkpoint neither loses nor doubles rows.
    """
    log_dir = f"{out_dir}/{CHANGES}"
    note_changes(spark, in_dir, log_dir, files_per_batch)
    changes = spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).parquet(log_dir)
    return (
        changes.writeStream.foreachBatch(_write_batch(spark, out_dir, host))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def files_read(spark: SparkSession, out_dir: str) -> DataFrame:
    """Every file that is there, as it was last read: path, length, modified, digest, n_documents, n_rejects."""
    last = _last(spark.read.schema(FILE).parquet(f"{out_dir}/{FILES}"), "batch")
    return last.filter("NOT gone").drop("gone", "held", "batch")


def _current(spark: SparkSession, out_dir: str, table: str) -> DataFrame:
    """Rows of the files that are there, from the batch that holds each."""
    files = spark.read.schema(FILE).parquet(f"{out_dir}/{FILES}")
    ended = files.select("batch").distinct()
    last = _last(files, "batch").filter("NOT gone").select("path", "held")
    old = (
        files.filter("held = batch").select("path", "held")
        .join(last, ["path", "held"], "left_anti")
        .select(F.col("path").alias("source"), F.col("held").alias("batch"))
    )
    rows = spark.read.parquet(f"{out_dir}/{table}").withColumn("batch", F.col("batch").cast("bigint"))
    # Empty as long as no file was replaced; and a batch counts when its files are noted.
    return rows.join(old, ["source", "batch"], "left_anti").join(F.broadcast(ended), "batch", "left_semi")


def ingested(spark: SparkSession, out_dir: str, table: str = ENTRIES) -> DataFrame:
    """What the files hold that have been ingested so far."""
    return _current(spark, out_dir, table).drop("batch", "source")


def ingested_containers(spark: SparkSession, out_dir: str) -> DataFrame:
    """(host, appid, file, complete, eligible) of every container, over all its files."""
    return containers_of(_current(spark, out_dir, PARTS))
