"""Container documents: one nested record per container, or per stretch of a long one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jumptrail.shared import written

ENTRY = "struct<_EntryNumber:string,_Path:string,_LastModified:string>"
LNK = (
    "struct<LinkInfo:struct<_LocalBasePath:string>,NAME_STRING:struct<_String:string>,"
    "COMMAND_LINE_ARGUMENTS:struct<_String:string>>"
)

# What a document says of itself, so that a reader sees whether anything is missing: its records, and in the first
# document of a container the records of all its documents.
DECLARED = ("ownEntries", "ownLnks", "allEntries", "allLnks")

# All attributes are text: one value of a wrong type must not reject its whole container.
DOCUMENT_SCHEMA = (
    "_host string, _appid string, _first string, "
    + "".join(f"_{name} string, " for name in DECLARED)
    +
    f"DestList struct<DestListEntryV2:array<{ENTRY}>>, LNKs struct<LNK:array<{LNK}>>, "
    "_corrupt_record string"
)

# A container with more records than this becomes several documents, each telling how many
# records come before it, so no group and no record grows with a hot container.
DOCUMENT_RECORDS = 1000

IDENTITY = ("host", "appid")


# What XML 1.0 has no way to write.
_UNWRITABLE = r"[^\t\n\r\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]"


def _cannot_write(*columns: str) -> Column:
    return F.rlike(F.concat_ws("", *columns), F.lit(_UNWRITABLE)).alias("unwritable")


def _attribute(value: Column, element: str) -> Column:
    return F.when(value.isNotNull(), F.struct(value.alias(element)))


def documents(entries: DataFrame, lnks: DataFrame, most: int = DOCUMENT_RECORDS) -> DataFrame:
    """Nested documents, of at most so many records each, of flat entries and link records; both need host, appid and
    position.

    Every document says how many records it has, the first one of a container also how many all have. `unwritable`
    tells documents with a character that XML cannot hold.
    """
    first = F.floor((F.col("position") - 1) / most) * most
    # Records move as they come, and become what is written in their document: as text they are twice as long.
    of_entry, of_lnk = ["position", "entry_number", "path", "last_modified"], ["position", "local_base_path", "name_string", "arguments"]

    def entry(row: Column) -> Column:
        return F.struct(
            row["position"].alias("position"),
            F.struct(
                row["entry_number"].cast("string").alias("_EntryNumber"),
                row["path"].alias("_Path"),
                row["last_modified"].cast("string").alias("_LastModified"),
            ).alias("one"),
        )

    def lnk(row: Column) -> Column:
        return F.struct(
            row["position"].alias("position"),
            F.struct(
                _attribute(row["local_base_path"], "_LocalBasePath").alias("LinkInfo"),
                _attribute(row["name_string"], "_String").alias("NAME_STRING"),
                _attribute(row["arguments"], "_String").alias("COMMAND_LINE_ARGUMENTS"),
            ).alias("one"),
        )

    head = [*IDENTITY, first.cast("bigint").alias("first")]
    no_entry = F.lit(None).cast(entries.select(*of_entry).schema).alias("entry")
    no_lnk = F.lit(None).cast(lnks.select(*of_lnk).schema).alias("lnk")
    nothing = F.lit(None).cast("bigint")
    records = entries.select(
        *head, F.struct(*of_entry).alias("entry"), no_lnk, _cannot_write(*IDENTITY, "path"),
        nothing.alias("allEntries"), nothing.alias("allLnks"),
    ).unionByName(
        lnks.select(
            *head, no_entry, F.struct(*of_lnk).alias("lnk"),
            _cannot_write(*IDENTITY, "local_base_path", "name_string", "arguments"),
            nothing.alias("allEntries"), nothing.alias("allLnks"),
        )
    )
    counts = (
        entries.select(*IDENTITY, F.lit(1).alias("e"), F.lit(0).alias("l"))
        .unionByName(lnks.select(*IDENTITY, F.lit(0).alias("e"), F.lit(1).alias("l")))
        .groupBy(*IDENTITY).agg(F.sum("e").alias("allEntries"), F.sum("l").alias("allLnks"))
    )
    totals = counts.select(
        *IDENTITY, F.lit(0).cast("bigint").alias("first"), no_entry, no_lnk, F.lit(False).alias("unwritable"), "allEntries", "allLnks"
    )
    grouped = records.unionByName(totals).groupBy(*IDENTITY, "first").agg(
        F.array_sort(F.transform(F.collect_list("entry"), entry)).alias("entries"),
        F.array_sort(F.transform(F.collect_list("lnk"), lnk)).alias("lnks"),
        F.bool_or("unwritable").alias("unwritable"),
        F.max("allEntries").alias("allEntries"),
        F.max("allLnks").alias("allLnks"),
    )
    return grouped.select(
        *IDENTITY,
        "first",
        F.when(
            F.size("entries") > 0, F.struct(F.col("entries.one").alias("DestListEntryV2"))
        ).alias("DestList"),
        F.when(F.size("lnks") > 0, F.struct(F.col("lnks.one").alias("LNK"))).alias("LNKs"),
        F.size("entries").cast("bigint").alias("ownEntries"),
        F.size("lnks").cast("bigint").alias("ownLnks"),
        "allEntries",
        "allLnks",
        "unwritable",
    )


def split_unwritable(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents of the containers that XML can hold, and the names of the other containers.

    One bad character would fail the whole export; so its container is left out and reported.
    Hand over a table: it is read for the bad containers and again for the rest. The bad ones are a table of their own,
    whose size Spark knows: as long as they are few, the documents stay where they are. The right side
    of the join is a plain scan, so Spark's skew join may cut a hot container on the left.
    """
    bad = written(docs.filter("unwritable").select(*IDENTITY).distinct(), "unwritable")
    rejects = bad.withColumn("file", F.concat("appid", F.lit(".xml")))
    return docs.join(bad, [*IDENTITY], "left_anti"), rejects


def parse_documents(df: DataFrame, column: str) -> DataFrame:
    """Container documents held as text in a column; the other columns stay."""
    parsed = F.from_xml(column, DOCUMENT_SCHEMA, {"mode": "PERMISSIVE", "ignoreSurroundingSpaces": "false"})
    others = [name for name in df.columns if name != column]
    # A generator, so that no filter above it makes Spark parse every document once more; the outer kind, for which
    # Spark infers no filter of its own.
    return df.select(*others, F.inline_outer(F.array(parsed)))


def split_rejects(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readable documents, and the others by file (source, host, AppID, first record and reason where known) with their raw text."""
    broken = F.col("_corrupt_record").isNotNull()
    known = [name for name in ("source", *IDENTITY, "first", "reason") if name in docs.columns]
    rejects = docs.filter(broken).select(*known, "file", F.col("_corrupt_record").alias("raw"))
    return docs.filter(~broken).drop("_corrupt_record"), rejects


def _counted(docs: DataFrame) -> DataFrame:
    """Documents with the numbers of records that were read from them, and whether those are the numbers they declare."""
    n_entries = F.greatest(F.coalesce(F.size("DestList.DestListEntryV2"), F.lit(0)), F.lit(0)).cast("bigint")
    n_lnks = F.greatest(F.coalesce(F.size("LNKs.LNK"), F.lit(0)), F.lit(0)).cast("bigint")
    found = docs.withColumns({"n_entries": n_entries, "n_lnks": n_lnks})
    short = F.lit(False)
    if "_corrupt_record" in docs.columns:
        short = F.col("_corrupt_record").isNotNull()
    for declared, number in (("ownEntries", "n_entries"), ("ownLnks", "n_lnks")):
        if declared in docs.columns:
            short = short | F.coalesce(F.col(declared) != F.col(number), F.lit(False))
    return found.withColumn("short", short)


def _incomplete(docs: DataFrame) -> Column:
    """In a group of all documents of a container: whether anything of it is missing."""
    missing = F.bool_or("short")
    if "allEntries" in docs.columns:
        told = F.max("allEntries").isNotNull() & F.max("allLnks").isNotNull()
        # A document that counts its records is one of several only if the first of them is there too.
        counts = F.bool_or(F.col("ownEntries").isNotNull())
        totals = (F.max("allEntries") != F.sum("n_entries")) | (F.max("allLnks") != F.sum("n_lnks"))
        missing = missing | F.when(told, totals).otherwise(counts)
    return missing


def container_parts(docs: DataFrame, *keys: str) -> DataFrame:
    """What was read of each container and what its documents declare, summed by container and other keys."""
    return (
        _counted(docs)
        .groupBy(*keys, *IDENTITY)
        .agg(
            F.sum("n_entries").alias("n_entries"), F.sum("n_lnks").alias("n_lnks"), F.bool_or("short").alias("short"),
            F.bool_or(F.col("DestList").isNotNull()).alias("has_list"), F.max("ownEntries").alias("ownEntries"),
            F.max("allEntries").alias("allEntries"), F.max("allLnks").alias("allLnks"),
        )
    )


def containers_of(parts: DataFrame) -> DataFrame:
    """(host, appid, file, complete, eligible) from the sums of `container_parts`."""
    found = parts.groupBy(*IDENTITY).agg(
        F.bool_or("has_list").alias("has_list"), F.sum("n_lnks").alias("n"), _incomplete(parts).alias("incomplete")
    )
    return found.select(
        *IDENTITY,
        F.concat("appid", F.lit(".xml")).alias("file"),
        (~F.col("incomplete")).alias("complete"),
        (F.col("has_list") & (F.col("n") > 0) & ~F.col("incomplete")).alias("eligible"),
    )


def split_incomplete(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents of the containers that are whole, and all documents of the others with the reason and their text.

    A container is whole if all its documents can be read and hold the records they declare, and together all that
    the first one declares; an export that declares nothing is whole if it can be read. Documents of one container
    must name the same host and AppID. Hand over a table, it is read twice; documents of a large container may be
    split among tasks, as the numbers meet only in a row per container.
    """
    counted = _counted(docs)
    bad = counted.groupBy(*IDENTITY).agg(_incomplete(docs).alias("incomplete")).filter("incomplete").select(*IDENTITY)
    # As a table its size is known, so a few containers move no documents.
    bad = written(bad, "incomplete")
    whole = docs.join(bad, [*IDENTITY], "left_anti").drop("_corrupt_record", "reason")
    known = [name for name in ("source", *IDENTITY, "first", "file") if name in docs.columns]
    reason = F.coalesce("reason", F.lit("part of an incomplete container")) if "reason" in docs.columns else F.lit("incomplete container")
    left = docs.join(bad, [*IDENTITY], "left_semi")
    return whole, left.select(*known, reason.alias("reason"), "raw")


def eligible(docs: DataFrame) -> DataFrame:
    """Whole containers that have a DestList and at least one link record: (host, appid, file)."""
    counted = _counted(docs)
    parts = counted.groupBy(*IDENTITY).agg(
        F.bool_or(F.col("DestList").isNotNull()).alias("has_list"),
        F.bool_or(F.col("n_lnks") > 0).alias("has_lnk"),
        _incomplete(docs).alias("incomplete"),
    )
    return parts.filter("has_list AND has_lnk AND NOT incomplete").select(
        *IDENTITY, F.concat("appid", F.lit(".xml")).alias("file")
    )


def entries_of(docs: DataFrame, *others: str) -> DataFrame:
    """DestList entries of the documents in document order, with other columns; only version 2 has a schema."""
    return docs.select(
        *others, *IDENTITY, "file", "first", F.posexplode("DestList.DestListEntryV2")
    ).select(
        *others,
        *IDENTITY,
        "file",
        (F.col("first") + F.col("pos") + 1).alias("position"),
        F.col("col._EntryNumber").try_cast("bigint").alias("entry_number"),
        F.col("col._Path").alias("path"),
        F.col("col._LastModified").alias("last_modified_text"),
        F.col("col._LastModified").try_cast("timestamp_ntz").alias("last_modified"),
    )


def lnks_of(docs: DataFrame, *others: str) -> DataFrame:
    """Link records of the documents, with other columns; any part may be missing, the position counts them all."""
    return docs.select(*others, *IDENTITY, "file", "first", F.posexplode("LNKs.LNK")).select(
        *others,
        *IDENTITY,
        "file",
        (F.col("first") + F.col("pos") + 1).alias("position"),
        F.col("col.LinkInfo._LocalBasePath").alias("local_base_path"),
        F.col("col.NAME_STRING._String").alias("name_string"),
        F.col("col.COMMAND_LINE_ARGUMENTS._String").alias("arguments"),
    )


def union_hosts(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of several collections in one table."""
    for other in others:
        first = first.unionByName(other)
    return first
