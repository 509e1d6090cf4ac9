"""Exported containers and their index as XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jumptrail.functions.text import file_stem
from jumptrail.operators.documents import DECLARED, entries_of, lnks_of, parse_documents, split_rejects
from jumptrail.sources.cutting import ROW_TAG, START
from jumptrail.sources.files import Paths, listed, unescaped, whole_files

INDEX_SCHEMA = "_host string, _file string, _appid string"

# Layout only: writers start a new file after this many rows.
DOCUMENTS_PER_FILE = 2000
INDEX_ROWS_PER_FILE = 1_000_000

# Layout only: of four blanks a level, as is usual, a fifth of an export would consist.
INDENT = " "


def read_pieces(spark: SparkSession, paths: Paths, empty: bool = True, skip_gone: bool = False) -> DataFrame:
    """(path, name, length, modified, digest, part, before, opening, text, reason) of files: a row for each document, or
    for each part of a long one, and for what is no document, with the reason.

    Every file has a row at least; an index has one without text. Who needs only documents can do without empty files.
    """
    files = listed(spark, paths)
    if not empty:
        files = files.filter("length > 0")
    return whole_files(spark, files, skip_gone)


def documents_of(pieces: DataFrame, host: str = "") -> DataFrame:
    """Documents of `read_pieces` with source (the file's path), digest, host, AppID and file; raw is their text, and
    what is unreadable has it in _corrupt_record. A long document is several, of which only the first has part 0, and
    whose part is negative where an earlier one has the same first record.

    An export by Spark says host and AppID in attributes; any other export says the AppID in the file name, and the
    host in a `host=` folder or by argument.
    """
    return _parsed(_rows_of(pieces).filter(F.col("text").isNotNull()), host)


def _rows_of(pieces: DataFrame) -> DataFrame:
    """Pieces with what the path says; an index file has one without text."""
    return pieces.select(
        F.col("path").alias("source"), "digest", "name", partition_value(F.col("path"), "host").alias("folder"),
        "part", "before", "opening", "text", "reason",
    )


def _parsed(rows: DataFrame, host: str) -> DataFrame:
    shown = F.coalesce("opening", "text")
    tag = F.when(
        shown.startswith(START), F.concat(F.regexp_extract(shown, rf"^{START}[^<>]*?(?=/*>|<|$)", 0), F.lit("/>"))
    )
    head = F.from_xml(tag, "_host string, _appid string, _first string", {"mode": "PERMISSIVE"})
    named = rows.withColumn("tag", head).select("source", "digest", "name", "part", "before", "text", "reason", "folder", "tag.*")
    appid = F.coalesce("_appid", file_stem(F.col("name")))
    named = named.select(
        "source",
        "digest",
        F.coalesce("_host", F.lit(host) if host else F.lit(None).cast("string"), "folder", F.lit("")).alias("host"),
        appid.alias("appid"),
        F.concat(appid, F.lit(".xml")).alias("file"),
        "part",
        (F.coalesce(F.col("_first").try_cast("bigint"), F.lit(0)) + F.col("before")).alias("first"),
        F.col("text").alias("raw"),
        F.when(F.col("reason").isNull(), F.col("text")).alias("text"),
        "reason",
    )
    parsed = parse_documents(named, "text").drop("_host", "_appid", "_first")
    broken = F.when(F.col("reason").isNotNull(), F.col("raw")).otherwise(F.col("_corrupt_record"))
    reason = F.when(broken.isNotNull(), F.coalesce("reason", F.lit("broken document")))
    return parsed.withColumns(
        {"_corrupt_record": broken, "reason": reason, **{name: F.col("_" + name).try_cast("bigint") for name in DECLARED}}
    ).drop(*("_" + name for name in DECLARED))


def partition_value(path: Column, key: str) -> Column:
    """What a `key=value` folder of a file's path says, with the escapes of the path and of the folder undone."""
    value = F.regexp_extract(path, f"/{key}=([^/]*)/", 1)
    for _ in range(2):
        value = F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B")))
    return F.when(value.isin("", "__HIVE_DEFAULT_PARTITION__"), None).otherwise(value)


def read_documents(spark: SparkSession, paths: Paths, host: str = "", empty: bool = True) -> DataFrame:
    """Container documents of files; unreadable ones, and files without any, have their text in _corrupt_record."""
    return documents_of(read_pieces(spark, paths, empty), host)


def account(spark: SparkSession, paths: Paths, host: str = "") -> DataFrame:
    """Every file that is there: (source, host, file, length, n_documents, n_rejects, n_entries, n_lnks, reasons).

    A file has a document or a reject at least, unless it is an index; one that reading left out has the reason
    "not read", so the listing is held against what was read.
    """
    files = listed(spark, paths)
    docs = _parsed(_rows_of(read_pieces(spark, files)), host)
    broken, index = F.col("_corrupt_record").isNotNull(), F.col("raw").isNull()
    good = ~broken & ~index
    begins = F.col("part") == 0
    read = docs.groupBy("source").agg(
        F.count_if(good & begins).alias("n_documents"), F.count_if(broken & begins).alias("n_rejects"),
        F.sum(F.when(good, F.greatest(F.size("DestList.DestListEntryV2"), F.lit(0))).otherwise(0)).alias("n_entries"),
        F.sum(F.when(good, F.greatest(F.size("LNKs.LNK"), F.lit(0))).otherwise(0)).alias("n_lnks"),
        F.sort_array(F.collect_set("reason")).alias("reasons"),
    )
    files = files.withColumnRenamed("path", "source").join(read, "source", "left")
    nothing = F.col("n_documents").isNull()
    return files.select(
        "source",
        F.coalesce(partition_value(F.col("source"), "host"), F.lit(host)).alias("host"),
        unescaped(F.element_at(F.split("source", "/"), -1)).alias("file"),
        "length",
        *(F.coalesce(name, F.lit(0)).cast("bigint").alias(name) for name in ("n_documents", "n_rejects", "n_entries", "n_lnks")),
        F.when(nothing, F.array(F.lit("not read")))
        .otherwise(F.coalesce("reasons", F.array().cast("array<string>"))).alias("reasons"),
    )


def read_entries(spark: SparkSession, path: str, host: str = "") -> DataFrame:
    """DestList entries of all exported containers that can be read."""
    return entries_of(split_rejects(read_documents(spark, path, host, empty=False))[0])


def read_lnks(spark: SparkSession, path: str, host: str = "") -> DataFrame:
    """Link records of all exported containers that can be read."""
    return lnks_of(split_rejects(read_documents(spark, path, host, empty=False))[0])


def write_documents(docs: DataFrame, path: str, per_container: bool = False) -> None:
    """Documents as XML.

    Many documents share a file, whose number follows the data size. `per_container` gives every
    container a directory of its own (host=.../appid=...), as the single-machine tool does.
    """
    shown = docs.select(
        *(["host", "appid"] if per_container else []),
        F.col("host").alias("_host"),
        F.col("appid").alias("_appid"),
        F.col("first").alias("_first"),
        *(F.col(name).alias("_" + name) for name in DECLARED if name in docs.columns),
        "DestList",
        "LNKs",
    )
    writer = (
        shown.write.format("xml")
        .option("rootTag", "jumpLists")
        .option("rowTag", ROW_TAG)
        .option("indent", INDENT)
        .option("maxRecordsPerFile", DOCUMENTS_PER_FILE)
    )
    (writer.partitionBy("host", "appid") if per_container else writer).save(path)


def write_index(containers: DataFrame, path: str) -> None:
    """Index of eligible containers: an autoFile element each."""
    (
        containers.select(
            F.col("host").alias("_host"), F.col("file").alias("_file"), F.col("appid").alias("_appid")
        )
        .write.format("xml")
        .option("rootTag", "autoFiles")
        .option("rowTag", "autoFile")
        .option("maxRecordsPerFile", INDEX_ROWS_PER_FILE)
        .save(path)
    )


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Index entries: (host, file, appid)."""
    index = spark.read.format("xml").option("rowTag", "autoFile").schema(INDEX_SCHEMA).load(path)
    return index.select(
        F.coalesce("_host", F.lit("")).alias("host"),
        F.col("_file").alias("file"),
        F.col("_appid").alias("appid"),
    )
