"""Input views derived from the given tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jumptrail.operators.activity import with_positions
from jumptrail.operators.appid import EXTENSION, appids
from jumptrail.operators.documents import DOCUMENT_RECORDS, documents
from jumptrail.operators.lookup import join_lookup
from jumptrail.shared import SMALL, fresh_path

T = TypeVar("T")

FX_PATHS = """
SELECT p_partkey AS path_id, CASE p_partkey % 12
 WHEN 0 THEN concat('C:',b,'Windows',b,'System32',b,exe)
 WHEN 1 THEN concat('C:',b,'Windows',b,'SysWOW64',b,p_type,b,exe)
 WHEN 2 THEN concat('c:',b,'windows',b,exe)
 WHEN 3 THEN concat('C:',b,'Windows',b,p_type,b,exe)
 WHEN 4 THEN concat('C:',b,'Program Files',b,p_brand,b,exe)
 WHEN 5 THEN concat('C:',b,'Program Files (x86)',b,p_brand,b,exe)
 WHEN 6 THEN concat('C:',b,'Program Files',b,'Common Files',b,p_brand,b,exe)
 WHEN 7 THEN concat('C:',b,'Program Files',b,exe)
 WHEN 8 THEN concat('{6D809377-6AF0-444b-8957-A3773F02200E}',b,p_brand,b,exe)
 WHEN 9 THEN concat('{7C5A40EF-A0FB-4BFC-874A-C0F2E0B9FA8E}',b,p_brand,b,exe)
 WHEN 10 THEN concat('C:',b,'Users',b,'bob',b,'AppData',b,'Roaming',b,exe)
 ELSE concat('Vendor.',p_brand,'.',exe) END AS path
FROM (SELECT p_partkey, p_type, p_brand, concat(replace(p_name,' ','_'),'.exe') AS exe, chr(92) AS b FROM part) p
"""

# One application holds a third of all entries.
FX_ENTRIES = """
SELECT event_id, concat('HOST-',CAST(event_id % 7 AS STRING)) AS host,
 CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS path_id, event_id + 1 AS entry_number,
 CASE event_id % 5 WHEN 4 THEN NULL ELSE concat('C:',chr(92),'Users',chr(92),'u',CAST(user_id AS STRING),chr(92),'Doc & <',CAST(event_id % 97 AS STRING),'>',
   CASE event_id % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.TXT' WHEN 2 THEN '.docx' ELSE '' END) END AS path,
 ts AS last_modified FROM events
"""

FX_PROCESSES = """
SELECT concat('HOST-',CAST(c_custkey % 7 AS STRING)) AS host, 1000 + 4 * c_custkey AS pid,
 concat('proc',CAST(c_custkey % 50 AS STRING)) AS process_name,
 CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey END AS path_id FROM customer
"""

# Some containers have no link records.
FX_LNKS = """
SELECT event_id, host, path_id, entry_number, path AS local_base_path,
 CASE event_id % 3 WHEN 0 THEN NULL ELSE concat('n',CAST(event_id % 11 AS STRING)) END AS name_string,
 CASE event_id % 4 WHEN 0 THEN concat('--v=',CAST(event_id % 10 AS STRING)) ELSE NULL END AS arguments
FROM fx_entries WHERE path_id % 9 <> 4
"""

FX_KNOWN_FILES = """
SELECT DISTINCT path FROM fx_entries WHERE event_id % 2 = 0 AND path IS NOT NULL
"""

FX_DROIDS = """
SELECT event_id, host, last_modified, concat('00000000-0000-',CASE event_id % 5 WHEN 0 THEN '4' ELSE '1' END,'000-8000-',lpad(CAST(event_id % 13 AS STRING),12,'0')) AS droid_uuid FROM fx_entries
"""

FX_IDS = """
SELECT c_custkey AS row_id, CASE c_custkey % 14 WHEN 0 THEN CAST(1000 + 4 * c_custkey AS STRING) WHEN 1 THEN concat('0x',hex(1000 + 4 * c_custkey))
 WHEN 2 THEN concat('0X',lower(hex(1000 + 4 * c_custkey))) WHEN 3 THEN '12zz' WHEN 4 THEN '4294967296' WHEN 5 THEN '0xZZ'
 WHEN 6 THEN concat(' +', CAST(1000 + 4 * c_custkey AS STRING), ' ') WHEN 7 THEN concat('0x 0000000', hex(1000 + 4 * c_custkey), ' ')
 WHEN 8 THEN '4294967295' WHEN 9 THEN '0xFFFFFFFF' WHEN 10 THEN '0x100000000' WHEN 11 THEN '-5' WHEN 12 THEN ' 0x10' ELSE '' END AS id_text FROM customer
"""

# Hex text of whole documents with bad, blank and missing digits.
FX_HEX = """
SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN concat('ZZ', substr(h, 3)) WHEN 1 THEN concat(' A', substr(h, 3))
 WHEN 2 THEN concat('b ', substr(h, 3)) WHEN 3 THEN concat(h, 'A') WHEN 4 THEN concat(h, '  0G') ELSE h END AS hex_text
FROM (SELECT doc_id, hex(encode({text})) AS h FROM documents) d
"""

# name -> (SQL, views it reads)
VIEWS = {
    "fx_paths": (FX_PATHS, []),
    "fx_entries": (FX_ENTRIES, []),
    "fx_processes": (FX_PROCESSES, []),
    "fx_lnks": (FX_LNKS, ["fx_entries"]),
    "fx_known_files": (FX_KNOWN_FILES, ["fx_entries"]),
    "fx_droids": (FX_DROIDS, ["fx_entries"]),
    "fx_ids": (FX_IDS, []),
    "fx_hex": (FX_HEX, []),
}

# The table each view comes from.
BASE = {
    "fx_paths": "part",
    "fx_entries": "events",
    "fx_processes": "customer",
    "fx_lnks": "events",
    "fx_known_files": "events",
    "fx_droids": "events",
    "fx_ids": "customer",
    "fx_hex": "documents",
}


def closure(names: list[str]) -> list[str]:
    """The named views with those they read, in order."""
    needed = set(names)
    for name in reversed(list(VIEWS)):
        if name in needed:
            needed.update(VIEWS[name][1])
    return [name for name in VIEWS if name in needed]


def with_clause(names: list[str], text: str) -> list[str]:
    """`name AS (SQL)` of each view; `text` is the argument of encode in the engine at hand."""
    return [f"{n} AS ({VIEWS[n][0].replace('{text}', text)})" for n in closure(names)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views over the tables of a folder."""
    table(spark, sf_dir, BASE[name]).createOrReplaceTempView(BASE[name])
    return spark.sql(f"WITH {', '.join(with_clause([name], 'text, ' + repr('UTF-8')))} SELECT * FROM {name}")


# What this application has already made of the tables of a folder.
_KEPT: dict[tuple, Any] = {}


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    """Files, lengths and times of the tables that the views read, so that changed tables give new answers."""
    found = []
    for name in sorted(set(BASE.values())):
        # Asked of the file system itself: a job for it takes longer than most of what is looked up.
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        files = place.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(place, True)
        while files.hasNext():
            status = files.next()
            found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return tuple(sorted(found))


def once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], T]) -> T:
    """What `make` returns, made once per application as long as the tables stay the same."""
    key = (spark.sparkContext.applicationId, sf_dir, name, _state(spark, sf_dir))
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def kept(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]) -> str:
    """Path of something written once in the shared folder."""

    def make() -> str:
        path = fresh_path(spark, name)
        write(path)
        return path

    return once(spark, sf_dir, name, make)


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate AppIDs of all paths as a written table: joins read it, they do not hash again.

    The hashes cost far more than the reading, so the paths are spread first: a small file is read by one task.
    """

    def write(path: str) -> None:
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        appids(view(spark, sf_dir, "fx_paths").repartition(parts)).write.parquet(path)

    return spark.read.parquet(kept(spark, sf_dir, "dictionary", write))


# Here one application's third of the entries is hot in a table of any size, so that queries take that way too.
FIXTURE_HOT_ROWS = 1000


def with_appid(df: DataFrame, cands: DataFrame) -> DataFrame:
    """Adds the AppID a container of the path is named by."""
    observed = cands.filter(F.col("variant").isin("1", "")).select(
        "path_id", F.lower("appid").alias("appid")
    )
    unknown = F.concat(F.lit("0bad"), F.col("path_id").cast("string"))
    found = join_lookup(df, observed, ["path_id"], "left", FIXTURE_HOT_ROWS)
    return found.withColumn("appid", F.coalesce("appid", unknown))


def _with_appid(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view with AppIDs as a written table, as hot keys are looked for where it is joined."""

    def write(path: str) -> None:
        rows = with_appid(view(spark, sf_dir, name), dictionary(spark, sf_dir))
        rows.write.option("compression", SMALL).parquet(path)

    return spark.read.parquet(kept(spark, sf_dir, f"{name}-with-appid", write))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_appid(spark, sf_dir, "fx_entries")


def lnks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_appid(spark, sf_dir, "fx_lnks")


def containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed containers as a written table."""

    def write(path: str) -> None:
        found = entries(spark, sf_dir).select("host", "appid").distinct()
        found.withColumn("file", F.concat("appid", F.lit(EXTENSION))).write.parquet(path)

    return spark.read.parquet(kept(spark, sf_dir, "containers", write))


def container_documents(spark: SparkSession, sf_dir: str, most: int = DOCUMENT_RECORDS) -> DataFrame:
    # What no document says does not move along.
    found = [rows(spark, sf_dir).drop("path_id") for rows in (entries, lnks)]
    placed = documents(*map(with_positions, found), most)
    return placed.withColumn("file", F.concat("appid", F.lit(".xml")))
