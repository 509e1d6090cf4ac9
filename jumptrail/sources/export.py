"""Exports in the shape of the single-machine tool: a file per container, and an index of them per host.

    <path>/host=<host>/<appid>.xml    root AutomaticDestinations, with DestList and LNKs
    <path>/host=<host>/master.xml     root autoFiles, an autoFile with file and appid for each, in order

Only eligible containers have a file, and only files that were written are in the index. A container is one file,
so one task streams it; the rows of that stream are documents of at most 1000 records each, already text, so the
task holds one of them at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jumptrail.shared import written
from jumptrail.sources.cutting import index_entries
from jumptrail.sources.files import Paths, listed, unescaped, whole_files
from jumptrail.sources.named import write_named
from jumptrail.sources.store import Store, listed_documents, stored_index
from jumptrail.sources.xml import ROW_TAG, partition_value

HEAD = '<?xml version="1.0" encoding="utf-8"?>\n'
MASTER = "master.xml"

# Characters that an attribute cannot hold as they are.
_REFERENCES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\t", "&#9;"), ("\n", "&#10;"), ("\r", "&#13;")]


def attribute(name: str, value: Column) -> Column:
    """` name="value"`; nothing for null."""
    for mark, reference in _REFERENCES:
        value = F.replace(value, F.lit(mark), F.lit(reference))
    return F.coalesce(F.concat(F.lit(f' {name}="'), value, F.lit('"')), F.lit(""))


def host_folder(host: Column) -> Column:
    """The folder of a host, its name escaped as Spark escapes partition values."""
    safe = F.replace(F.url_encode(host), F.lit("+"), F.lit("%20"))
    return F.concat(F.lit("host="), F.when(host == "", "__HIVE_DEFAULT_PARTITION__").otherwise(safe))


def _entry(entry: Column) -> Column:
    parts = [attribute(name, entry["_" + name]) for name in ("EntryNumber", "Path", "LastModified")]
    return F.concat(F.lit("    <DestListEntryV2"), *parts, F.lit("/>\n"))


def _lnk(lnk: Column) -> Column:
    def part(element: str, name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"<{element}"), attribute(name, value), F.lit("/>"))).otherwise("")

    return F.concat(
        F.lit("    <LNK>"),
        part("LinkInfo", "LocalBasePath", lnk["LinkInfo"]["_LocalBasePath"]),
        part("NAME_STRING", "String", lnk["NAME_STRING"]["_String"]),
        part("COMMAND_LINE_ARGUMENTS", "String", lnk["COMMAND_LINE_ARGUMENTS"]["_String"]),
        F.lit("</LNK>\n"),
    )


def container_texts(docs: DataFrame) -> DataFrame:
    """(host, file, section, first, text): what the container's file is made of, in the order of section and first."""

    def joined(records: Column, line) -> Column:
        return F.array_join(F.coalesce(F.transform(records, line), F.array()), "")

    def part(section: int, text: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), text.alias("text"))

    frame = [
        part(0, F.lit(f"{HEAD}<{ROW_TAG}>\n  <DestList>\n")),
        part(2, F.lit("  </DestList>\n  <LNKs>\n")),
        part(4, F.lit(f"  </LNKs>\n</{ROW_TAG}>\n")),
    ]
    parts = [part(1, joined(F.col("DestList.DestListEntryV2"), _entry)), part(3, joined(F.col("LNKs.LNK"), _lnk))]
    every = F.concat(F.array(*parts), F.when((F.col("first") == 0) & (F.col("part") >= 0), F.array(*frame)).otherwise(F.array()))
    return docs.select("host", "file", "first", F.inline(every)).filter("text <> ''")


def export_containers(spark: SparkSession, store: Store, path: str) -> None:
    """Write the files of the containers that the index lists, and then the index of those that are there."""
    name = F.concat(host_folder(F.col("host")), F.lit("/"), F.col("file"))
    rows = container_texts(listed_documents(spark, store)).select(
        name.alias("name"), "section", "first", F.col("text").cast("binary").alias("content")
    )
    write_named(rows.repartition("name").sortWithinPartitions("name", "section", "first"), path)
    write_master(spark, stored_index(spark, store), path)


def write_master(spark: SparkSession, index: DataFrame, path: str) -> None:
    """Write each host's index of the files that exist, in the order of `place`."""
    there = listed(spark, path).select(
        F.coalesce(partition_value(F.col("path"), "host"), F.lit("")).alias("host"),
        unescaped(F.element_at(F.split("path", "/"), -1)).alias("file"),
    )
    entries = index.join(there, ["host", "file"], "left_semi")
    element = F.concat(F.lit("  <autoFile"), attribute("file", F.col("file")), attribute("appid", F.col("appid")), F.lit("/>\n"))
    lines = entries.select("host", F.lit(1).alias("section"), "place", element.alias("text"))
    ends = entries.select("host").distinct().select(
        "host",
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("section"), F.lit(0).cast("bigint").alias("place"), F.lit(HEAD + "<autoFiles>\n").alias("text")),
                F.struct(F.lit(2).alias("section"), F.lit(0).cast("bigint").alias("place"), F.lit("</autoFiles>\n").alias("text")),
            )
        ),
    )
    name = F.concat(host_folder(F.col("host")), F.lit(f"/{MASTER}"))
    rows = lines.unionByName(ends).select(name.alias("name"), "section", "place", F.col("text").cast("binary").alias("content"))
    # Stored first: writing the index must not look at a folder that it changes.
    rows = written(rows, "master")
    write_named(rows.repartition("name").sortWithinPartitions("name", "section", "place"), path)


def read_master(spark: SparkSession, paths: Paths) -> DataFrame:
    """(host, place, file, appid) of index files, the place counted from 1 within each file."""
    files = whole_files(spark, listed(spark, paths).filter(F.col("location").endswith(MASTER)), cut=index_entries)
    schema = "autoFile array<struct<_file:string,_appid:string>>"
    entries = F.from_xml("text", schema, {"mode": "PERMISSIVE"})["autoFile"]
    return files.select(
        F.coalesce(partition_value(F.col("path"), "host"), F.lit("")).alias("host"), "before", F.posexplode(entries)
    ).select("host", (F.col("before") + F.col("pos") + 1).cast("bigint").alias("place"), F.col("col._file").alias("file"), F.col("col._appid").alias("appid"))
