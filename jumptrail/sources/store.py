"""Exports parsed once into stored tables, so that index, entries and link records meet without a shuffle.

`documents` holds the whole containers, a row per document with its entries and its link records side by side;
`index` holds a row per document of every eligible container, with the container's place in the index. Both are
bucketed by (host, file, first): a container of any size is spread by its documents of at most 1000 records each, so
no bucket holds a hot container. `containers` says of every container whether it is whole and eligible, `rejects`
has what could not be read and all documents of containers that are not whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jumptrail.operators.documents import container_parts, containers_of, split_incomplete
from jumptrail.operators.ordering import ranked
from jumptrail.shared import bucketed, fresh_path, written
from jumptrail.sources.files import Paths
from jumptrail.sources.xml import documents_of, read_pieces

KEY = ("host", "file", "first")


@dataclass(frozen=True)
class Store:
    """Names of the bucketed tables and the folders of the others."""

    documents: str
    index: str
    containers: str
    rejects: str


def _bucketed(df: DataFrame, name: str, buckets: int) -> str:
    return bucketed(df.repartition(buckets, *KEY), name, buckets, KEY)


def store_export(spark: SparkSession, paths: Paths, host: str = "", buckets: int | None = None) -> Store:
    """Read an export once and store it; as many buckets as shuffle partitions unless a number is given."""
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = written(documents_of(read_pieces(spark, paths), host), "parsed")
    folder = fresh_path(spark, "containers")
    containers_of(container_parts(docs)).write.parquet(folder)
    containers = spark.read.parquet(folder)
    whole, left = split_incomplete(docs)
    rejects = fresh_path(spark, "rejects")
    left.write.parquet(rejects)
    pieces = whole.select(*KEY, "part", "appid", "DestList", "LNKs")
    return Store(_bucketed(pieces, "documents", buckets), store_index(containers, docs, buckets), folder, rejects)


def store_index(containers: DataFrame, docs: DataFrame, buckets: int) -> str:
    """The index of the eligible containers, by host and file, as a table with a row for each of their documents."""
    listed = containers.filter("eligible").select("host", "file", "appid")
    placed = ranked(listed, [F.asc("host"), F.asc("file")], into="place")
    return _bucketed(docs.filter("part >= 0").select(*KEY).join(placed, ["host", "file"]), "index", buckets)


def stored_index(spark: SparkSession, store: Store) -> DataFrame:
    """(host, file, appid, place) of the listed containers."""
    return spark.table(store.index).filter("first = 0").drop("first")


def listed_documents(spark: SparkSession, store: Store) -> DataFrame:
    """Documents of the containers that the index lists, with their place; both tables are read bucket by bucket."""
    return spark.table(store.documents).join(spark.table(store.index).select(*KEY, "place"), [*KEY])


def release(spark: SparkSession, store: Store) -> None:
    """Drop the tables; their files stay in the shared folder until it is cleared."""
    for table in (store.documents, store.index):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
