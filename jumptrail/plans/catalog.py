"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jumptrail.functions import binary
from jumptrail.functions.crc64 import crc64
from jumptrail.functions.ids import parse_id
from jumptrail.functions.registry import register_functions
from jumptrail.functions.text import appid_hex, upper_invariant
from jumptrail.known_folders import known_folders, with_guid_use
from jumptrail.operators import activity, appid, documents, identify, report
from jumptrail.plans import fixtures as fx
from jumptrail.shared import SMALL, fresh_path, written
from jumptrail.sources import containers as files
from jumptrail.sources import export, named, store, xml
from jumptrail.sources.files import listed
from jumptrail.streaming import ingest, recents

TOP = 10

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _paths(spark, sf_dir):
    return fx.view(spark, sf_dir, "fx_paths")


def _new_export(
    spark: SparkSession, sf_dir: str, path: str | None = None, per_container: bool = False
) -> str:
    path = path or fresh_path(spark, "export")
    docs = written(fx.container_documents(spark, sf_dir), "documents", SMALL)
    good, _ = documents.split_unwritable(docs)
    xml.write_documents(good, path, per_container)
    return path


def _export(spark: SparkSession, sf_dir: str) -> str:
    return fx.kept(spark, sf_dir, "export", lambda path: _new_export(spark, sf_dir, path))


# --- paths and AppIDs ---


@query
def path_split(spark, sf_dir):
    return appid.with_split(_paths(spark, sf_dir)).select("path_id", "dir", "fname")


@query
def env_form(spark, sf_dir):
    return appid.classified(_paths(spark, sf_dir)).select("path_id", "env_dir")


@query
def known_folder_form(spark, sf_dir):
    folders = appid.with_env_dir(appid.with_split(_paths(spark, sf_dir)))
    return appid.with_known_folder_form(folders, "env_dir").select("path_id", "known_folder_form")


@query
def path_class(spark, sf_dir):
    return appid.classified(_paths(spark, sf_dir)).select("path_id", "class")


@query
def candidates(spark, sf_dir):
    return appid.candidates(_paths(spark, sf_dir))


@query
def appid_candidates(spark, sf_dir):
    return appid.appids(_paths(spark, sf_dir))


@query
def appid_sql(spark, sf_dir):
    register_functions(spark)
    appid.candidates(_paths(spark, sf_dir)).createOrReplaceTempView("path_candidates")
    return spark.sql(
        "SELECT path_id, variant, ltrim('0', hex(appid_crc64(guid_path))) AS appid FROM path_candidates"
    )


@query
def jumplist_names(spark, sf_dir):
    found = appid.appids(_paths(spark, sf_dir))
    return found.select("path_id", "variant", appid.file_name("appid").alias("name"))


@query
def decode_names(spark, sf_dir):
    names = fx.containers(spark, sf_dir).select("host", F.col("file").alias("name"))
    return appid.decode_name(names)


@query
def path_ambiguity(spark, sf_dir):
    return appid.path_ambiguity(_paths(spark, sf_dir))


@query
def appid_collisions(spark, sf_dir):
    return appid.appid_collisions(fx.dictionary(spark, sf_dir))


@query
def guid_containment(spark, sf_dir):
    return appid.guid_containment(_paths(spark, sf_dir))


@query
def known_guids(spark, sf_dir):
    return with_guid_use(known_folders(spark), _paths(spark, sf_dir))


# --- identification ---


@query
def identify_apps(spark, sf_dir):
    return identify.identify_apps(fx.containers(spark, sf_dir), fx.dictionary(spark, sf_dir))


@query
def candidate_matches(spark, sf_dir):
    return identify.candidate_matches(
        fx.containers(spark, sf_dir), fx.dictionary(spark, sf_dir)
    )


@query
def unidentified(spark, sf_dir):
    return identify.unidentified(fx.containers(spark, sf_dir), fx.dictionary(spark, sf_dir))


@query
def resolve_processes(spark, sf_dir):
    return identify.resolve_processes(
        fx.view(spark, sf_dir, "fx_processes"), fx.dictionary(spark, sf_dir)
    )


@query
def process_by_id(spark, sf_dir):
    return identify.select_processes(
        fx.view(spark, sf_dir, "fx_processes").drop("path_id"), fx.view(spark, sf_dir, "fx_ids")
    )


@query
def window_by_id(spark, sf_dir):
    processes = fx.view(spark, sf_dir, "fx_processes").drop("path_id")
    windows = processes.withColumnRenamed("pid", "window_id")
    return identify.select_processes(windows, fx.view(spark, sf_dir, "fx_ids"), "window_id")


@query
def parse_ids(spark, sf_dir):
    ids = fx.view(spark, sf_dir, "fx_ids")
    return ids.select("row_id", "id_text", parse_id("id_text").alias("id"))


# --- activity ---


@query
def container_counts(spark, sf_dir):
    return activity.container_counts(fx.entries(spark, sf_dir), fx.lnks(spark, sf_dir))


@query
def recent_docs(spark, sf_dir):
    return activity.recent_docs(fx.entries(spark, sf_dir))


@query
def recent_docs_top(spark, sf_dir):
    return activity.recent_docs(fx.entries(spark, sf_dir), TOP)


@query
def frequent_docs(spark, sf_dir):
    return activity.frequent_docs(fx.entries(spark, sf_dir), TOP)


@query
def usage_summary(spark, sf_dir):
    return activity.usage_summary(fx.entries(spark, sf_dir))


@query
def mac_attribution(spark, sf_dir):
    return activity.mac_attribution(fx.view(spark, sf_dir, "fx_droids"))


@query
def activity_by_day(spark, sf_dir):
    return activity.activity_by_day(fx.view(spark, sf_dir, "fx_entries"))


@query
def timeline_gaps(spark, sf_dir):
    found = fx.view(spark, sf_dir, "fx_entries")
    return activity.timeline_gaps(found.select("host", "event_id", "last_modified", "path"))


@query
def admissible_adds(spark, sf_dir):
    adds = fx.view(spark, sf_dir, "fx_entries").select("event_id", "host", "path")
    return activity.admissible(adds, fx.view(spark, sf_dir, "fx_known_files"))


@query
def top_entries(spark, sf_dir):
    return activity.top_entries(fx.view(spark, sf_dir, "fx_entries"), TOP).select(
        "event_id", "host", "path", "last_modified"
    )


def _sortable(spark, sf_dir, column):
    # Only what the sort needs, as a ranked table is written in between.
    return fx.entries(spark, sf_dir).select("host", "appid", "event_id", column)


def _placed(df):
    return df.select("host", "appid", "event_id", "rank")


@query
def sort_by_number(spark, sf_dir):
    return _placed(activity.sort_by_number(_sortable(spark, sf_dir, "entry_number")))


@query
def sort_by_number_desc(spark, sf_dir):
    found = _sortable(spark, sf_dir, "entry_number")
    return _placed(activity.sort_by_number(found, ascending=False))


@query
def sort_by_path(spark, sf_dir):
    return _placed(activity.sort_by_text(_sortable(spark, sf_dir, "path"), "path"))


@query
def sort_by_modified(spark, sf_dir):
    found = _sortable(spark, sf_dir, "last_modified")
    return _placed(activity.sort_by_text(found, "last_modified", ascending=False))


@query
def sort_all_by_path(spark, sf_dir):
    everything = fx.view(spark, sf_dir, "fx_entries").select("host", "event_id", "path")
    return activity.sort_by_text(everything, "path", keys=()).select("event_id", "rank")


# --- XML, index and report ---


@query
def container_inventory(spark, sf_dir):
    """Container files in a folder per host; here the paths of a container's entries stand for its bytes."""
    path = fresh_path(spark, "files")
    found = fx.entries(spark, sf_dir).select("host", "appid", "event_id", "path")
    name = F.concat(export.host_folder(F.col("host")), F.lit("/"), appid.file_name("appid"))
    line = F.concat(F.coalesce("path", F.lit("")), F.lit("\n")).cast("binary")
    rows = found.select(name.alias("name"), line.alias("content"))
    named.write_named(rows.repartition("name").sortWithinPartitions("name"), path)
    return files.scan_containers(spark, f"{path}/*").select("host", "appid", "file", "length")


@query
def entries_xml_roundtrip(spark, sf_dir):
    back = xml.read_entries(spark, _new_export(spark, sf_dir))
    return back.drop("last_modified_text")


@query
def lnks_xml_roundtrip(spark, sf_dir):
    return xml.read_lnks(spark, _export(spark, sf_dir))


@query
def lnk_positions(spark, sf_dir):
    return xml.read_lnks(spark, _export(spark, sf_dir)).select("host", "file", "position", "local_base_path")


@query
def eligible_containers(spark, sf_dir):
    return documents.eligible(xml.read_documents(spark, _export(spark, sf_dir)))


def _index(spark, sf_dir):
    path = fresh_path(spark, "index")
    xml.write_index(eligible_containers(spark, sf_dir), path)
    return xml.read_index(spark, path)


@query
def index_roundtrip(spark, sf_dir):
    return _index(spark, sf_dir)


def _store(spark, sf_dir):
    """The export parsed once into stored tables."""
    return fx.once(spark, sf_dir, "store", lambda: store.store_export(spark, _export(spark, sf_dir)))


@query
def index_join(spark, sf_dir):
    docs = store.listed_documents(spark, _store(spark, sf_dir))
    return documents.entries_of(docs).select("host", "file", "position", "path")


@query
def report_rows(spark, sf_dir):
    return report.document_rows(store.listed_documents(spark, _store(spark, sf_dir)).drop("place"))


@query
def report_html(spark, sf_dir):
    return report.report_html(report_rows(spark, sf_dir), store.stored_index(spark, _store(spark, sf_dir)))


@query
def custom_report(spark, sf_dir):
    """A report of the user's own: rows per container and section, and how many have a name."""

    def sections(rows):
        return rows.groupBy("host", "file", "section").agg(
            F.count("*").alias("n_rows"), F.count("c2").alias("n_paths")
        )

    return report.custom_report(report_rows(spark, sf_dir), sections)


def _reference_export(spark, sf_dir, path=None, content=None):
    """The stored containers as a file each, perhaps with other contents than their texts."""
    path = path or fresh_path(spark, "reference")
    if content is None:
        export.export_containers(spark, _store(spark, sf_dir), path)
        return path
    rows = export.container_texts(store.listed_documents(spark, _store(spark, sf_dir)))
    name = F.concat(export.host_folder(F.col("host")), F.lit("/"), F.col("file"))
    rows = rows.select(name.alias("name"), "section", "first", content.alias("content")).filter("content IS NOT NULL")
    named.write_named(rows.repartition("name").sortWithinPartitions("name", "section", "first"), path)
    return path


@query
def reference_export(spark, sf_dir):
    """Every entry of the index with what its file holds."""
    files = listed(spark, _reference_export(spark, sf_dir))
    opened = xml.account(spark, files).select("host", "file", "n_documents", "n_entries", "n_lnks")
    return export.read_master(spark, files).join(opened, ["host", "file"], "left")


@query
def index_order(spark, sf_dir):
    return store.stored_index(spark, _store(spark, sf_dir))


@query
def hosts_union(spark, sf_dir):
    """Entries of two hosts in one table, each read from its own folder; the same AppIDs occur in both."""
    path = _reference_export(spark, sf_dir)
    hosts = [xml.read_entries(spark, f"{path}/host={host}", host) for host in ("HOST-0", "HOST-1")]
    return documents.union_hosts(*hosts).select("host", "file", "position", "path")


def _odd_content() -> Column:
    """The text of a container in an encoding, or damaged in a way, that depends on its host."""
    text, host, section = F.col("text"), F.col("host"), F.col("section")
    latin = F.replace(F.replace(text, F.lit("utf-8"), F.lit("ISO-8859-1")), F.lit("Doc"), F.lit("D\u00f6c"))
    mark = F.when(section == 0, F.unhex(F.lit("FFFE"))).otherwise(F.unhex(F.lit("")))
    return (
        F.when(host == "HOST-1", F.concat(mark, F.encode(text, "UTF-16LE")))
        .when(host == "HOST-2", F.when(section == 0, F.unhex(F.repeat(F.lit("00"), 500))))
        .when(host == "HOST-3", F.when(section == 0, F.substring(text, 1, 50).cast("binary")))
        .when(host == "HOST-4", F.encode(latin, "ISO-8859-1"))
        .when(host == "HOST-5", F.when(section == 0, F.lit("").cast("binary")))
        .otherwise(text.cast("binary"))
    )


@query
def file_accounts(spark, sf_dir):
    """Files in several encodings, of zeros, cut inside the start tag and empty ones: what each of them gave."""
    found = xml.account(spark, _reference_export(spark, sf_dir, content=_odd_content()))
    return found.select("host", "file", "n_documents", "n_rejects", "n_entries", F.concat_ws(";", "reasons").alias("reason"))


@query
def encoded_entries(spark, sf_dir):
    """Entries of the files that can be read, whatever their encoding."""
    path = _reference_export(spark, sf_dir, content=_odd_content())
    return xml.read_entries(spark, path).select("host", "file", "position", "path")


def _incomplete_export(spark, sf_dir):
    """Containers in several documents; of one host every second document is broken, of another every third is gone."""
    docs = fx.container_documents(spark, sf_dir, PIECE).select(
        *(F.col(name).alias("_" + name) for name in ("host", "appid", "first", *documents.DECLARED)), "DestList", "LNKs"
    )
    text = F.to_xml(F.struct(*docs.columns), {"rowTag": xml.ROW_TAG})
    broken = (F.col("_host") == "HOST-3") & (F.col("_first") == PIECE)
    lost = (F.col("_host") == "HOST-5") & (F.col("_first") == 2 * PIECE)
    path = fresh_path(spark, "incomplete")
    rows = docs.select("_host", "_first", text.alias("text")).filter(~lost)
    rows.select(F.when(broken, F.expr("left(text, length(text) - 30)")).otherwise(F.col("text"))).write.text(path)
    return written(xml.read_documents(spark, path), "parsed")


# Records of a document where containers are to have several.
PIECE = 20


@query
def incomplete_containers(spark, sf_dir):
    """Containers of which a document is broken or missing: all that is left of them is among the rejects."""
    _, left = documents.split_incomplete(_incomplete_export(spark, sf_dir))
    return left.groupBy("host", "file").agg(
        F.count("*").alias("n_documents"), F.count_if(F.col("reason") == "broken document").alias("n_broken")
    )


@query
def whole_containers(spark, sf_dir):
    """Entries of the containers beside them, all of them."""
    whole, _ = documents.split_incomplete(_incomplete_export(spark, sf_dir))
    return documents.entries_of(whole).select("host", "file", "position", "path")


def _damaged_export(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """An export in which the documents of one host break off among others in the same files, and those documents."""
    docs = fx.container_documents(spark, sf_dir).select(
        F.col("host").alias("_host"), F.col("appid").alias("_appid"), F.col("first").alias("_first"), "DestList", "LNKs"
    )
    text = F.to_xml(F.struct(*docs.columns), {"rowTag": xml.ROW_TAG})
    cut = F.when(F.col("_host") == "HOST-3", F.expr("left(text, length(text) - 30)")).otherwise(F.col("text"))
    texts = written(docs.select("_host", "_appid", "_first", text.alias("text")).withColumn("text", cut), "texts")
    path = fresh_path(spark, "damaged")
    texts.select("text").write.text(path)
    return path, texts.filter("_host = 'HOST-3'")


@query
def rejects(spark, sf_dir):
    """Documents that break off inside shared files: by name, and whether their text is theirs alone."""
    path, broken = _damaged_export(spark, sf_dir)
    _, found = documents.split_rejects(xml.read_documents(spark, path))
    same = F.trim(F.regexp_replace("raw", "\\s+$", "")) == F.trim(F.regexp_replace("text", "\\s+$", ""))
    theirs = (F.col("host") == F.col("_host")) & (F.col("appid") == F.col("_appid")) & (F.col("first") == F.col("_first"))
    return found.join(broken, theirs, "left").select(
        F.concat_ws("/", "host", "file", "first").alias("file"), F.coalesce(same, F.lit(False)).alias("has_text")
    )


@query
def survivors(spark, sf_dir):
    """Entries of the documents beside broken ones: all of them."""
    path, _ = _damaged_export(spark, sf_dir)
    return xml.read_entries(spark, path).select("host", "file", "position", "path")


# --- text and bytes ---


@query
def crc64_values(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents")
    return docs.select("doc_id", appid_hex(crc64("text")).alias("crc"))


@query
def invariant_upper(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents")
    return docs.select("doc_id", upper_invariant("text").alias("upper_text"))


def _blobs(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.encode("text", "UTF-8").alias("data"))


@query
def hexdump(spark, sf_dir):
    return binary.hexdump(_blobs(spark, sf_dir), "data", "doc_id")


@query
def reverse_bytes(spark, sf_dir):
    blobs = _blobs(spark, sf_dir)
    return blobs.select(
        "doc_id",
        F.hex(binary.reverse_bytes("data")).alias("whole"),
        F.hex(binary.reverse_bytes("data", 100)).alias("after_100"),
    )


@query
def bytes_from_hex(spark, sf_dir):
    texts = fx.view(spark, sf_dir, "fx_hex")
    return texts.select(
        "doc_id",
        F.hex(binary.bytes_from_hex("hex_text")).alias("bytes"),
        binary.has_odd_length("hex_text").alias("odd_length"),
    )


# --- streaming ---


@query
def stream_ingest(spark, sf_dir):
    out, checkpoint = fresh_path(spark, "ingested"), fresh_path(spark, "ingest-checkpoint")
    ingest.stream_ingest(spark, _export(spark, sf_dir), out, checkpoint).awaitTermination()
    return ingest.ingested(spark, out).drop("last_modified_text")


@query
def stream_ingest_lnks(spark, sf_dir):
    out, checkpoint = fresh_path(spark, "ingested"), fresh_path(spark, "ingest-checkpoint")
    ingest.stream_ingest(spark, _export(spark, sf_dir), out, checkpoint).awaitTermination()
    return ingest.ingested(spark, out, ingest.LNKS)


@query
def stream_rescan(spark, sf_dir):
    """Files of one host are written again with other contents, of another with the same: what is held afterwards."""
    out, checkpoint = fresh_path(spark, "ingested"), fresh_path(spark, "ingest-checkpoint")
    path = _reference_export(spark, sf_dir)
    ingest.stream_ingest(spark, path, out, checkpoint).awaitTermination()
    changed = F.replace("text", F.lit("Doc"), F.lit("Note"))
    again = F.when(F.col("host") == "HOST-1", changed).when(F.col("host") == "HOST-6", F.col("text"))
    _reference_export(spark, sf_dir, path, again.cast("binary"))
    ingest.stream_ingest(spark, path, out, checkpoint).awaitTermination()
    return ingest.ingested(spark, out).select("host", "file", "position", "path")


@query
def stream_recents(spark, sf_dir):
    schema = fx.table(spark, sf_dir, "events").schema
    known = fx.view(spark, sf_dir, "fx_known_files")
    cands = fx.dictionary(spark, sf_dir)
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    events.parquet(sf_dir).createOrReplaceTempView("events")
    adds = fx.with_appid(spark.sql(fx.FX_ENTRIES), cands)
    out, checkpoint = fresh_path(spark, "recents"), fresh_path(spark, "recents-checkpoint")
    recents.stream_recents(adds, known, out, checkpoint).awaitTermination()
    return recents.recents(spark, out)
