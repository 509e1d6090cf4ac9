"""Recent and frequent documents, usage, timelines and orderings over entries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jumptrail.operators.lookup import join_lookup
from jumptrail.operators.ordering import ranked, with_previous

CONTAINER = ("host", "appid")

# Up to this many rows per group Spark cuts each group down before it shuffles.
GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


# What tells entries apart and keeps those of a container in document order.
_PLACE = ("host", "appid", "position", "event_id")


def _place(entries: DataFrame) -> list[str]:
    return [name for name in _PLACE if name in entries.columns]


def _first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """Ranked rows of each group, the first k of them; all of them for 0."""
    if 0 < k <= int(df.sparkSession.conf.get(GROUP_LIMIT)):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return df.withColumn("rank", place.cast("bigint")).filter(F.col("rank") <= k)
    placed = ranked(df, order, keys)
    return placed.filter(F.col("rank") <= k) if k else placed


def named(entries: DataFrame) -> DataFrame:
    """Entries that have a path."""
    return entries.filter(F.col("path").isNotNull() & (F.col("path") != ""))


def latest(entries: DataFrame) -> DataFrame:
    """Last time of each document of each AppID."""
    return named(entries).groupBy("appid", "path").agg(
        F.max("last_modified").alias("last_modified")
    )


def recent_docs(entries: DataFrame, k: int = 0) -> DataFrame:
    """Documents of each AppID, newest first: (appid, path, last_modified, rank)."""
    order = [F.desc("last_modified"), F.asc("path")]
    return _first_per_group(latest(entries), ["appid"], order, k)


def frequent_docs(entries: DataFrame, k: int) -> DataFrame:
    """Documents of each AppID with the most entries: (appid, path, n, rank)."""
    counted = named(entries).groupBy("appid", "path").agg(F.count("*").alias("n"))
    return _first_per_group(counted, ["appid"], [F.desc("n"), F.asc("path")], k)


def top_entries(entries: DataFrame, k: int) -> DataFrame:
    """The k newest entries of all."""
    return entries.orderBy(F.desc("last_modified"), *_place(entries)).limit(k)


def existing(df: DataFrame, known_files: DataFrame, key: str = "path") -> DataFrame:
    """Rows whose path is a known file."""
    return join_lookup(df, known_files.select(key).distinct(), [key], "left_semi")


def admissible_names(adds: DataFrame) -> DataFrame:
    """Additions whose name ends in .txt, in any case."""
    return named(adds).filter(F.endswith(F.lower("path"), F.lit(".txt")))


def admissible(adds: DataFrame, known_files: DataFrame) -> DataFrame:
    """Additions the recent list takes: a file that exists and whose name ends in .txt."""
    return existing(admissible_names(adds), known_files)


def container_counts(
    entries: DataFrame, lnks: DataFrame, keys: Sequence[str] = CONTAINER
) -> DataFrame:
    """Number of entries and of link records per container, in one aggregation."""
    tagged = entries.select(*keys, F.lit(1).alias("e"), F.lit(0).alias("l")).unionByName(
        lnks.select(*keys, F.lit(0).alias("e"), F.lit(1).alias("l"))
    )
    return tagged.groupBy(*keys).agg(F.sum("e").alias("n_entries"), F.sum("l").alias("n_lnks"))


def usage_summary(entries: DataFrame) -> DataFrame:
    """Entries, distinct documents, first and last time per host and AppID."""
    return entries.groupBy("host", "appid").agg(
        F.count("*").alias("n"),
        F.count_distinct("path").alias("n_docs"),
        F.min("last_modified").alias("first_seen"),
        F.max("last_modified").alias("last_seen"),
    )


def mac_attribution(droids: DataFrame) -> DataFrame:
    """Network addresses in version-1 identifiers, per host, with first and last time."""
    digits = F.replace(F.lower("droid_uuid"), F.lit("-"), F.lit(""))
    time_based = droids.withColumn("_digits", digits).filter(
        F.rlike("_digits", F.lit(r"\A[0-9a-f]{12}1[0-9a-f]{19}\z"))
    )
    return time_based.groupBy(F.substring("_digits", 21, 12).alias("mac"), "host").agg(
        F.count("*").alias("n"),
        F.min("last_modified").alias("first_seen"),
        F.max("last_modified").alias("last_seen"),
    )


def activity_by_day(entries: DataFrame) -> DataFrame:
    """Entries per host and day, the day as the time it starts."""
    day = F.to_date("last_modified").cast("timestamp_ntz").alias("day")
    return entries.groupBy("host", day).agg(F.count("*").alias("n"))


def timeline_gaps(entries: DataFrame) -> DataFrame:
    """Every entry with the time of the host's previous one and the seconds between them."""
    order = ["last_modified", *(name for name in _place(entries) if name != "host")]
    lined = with_previous(entries, "last_modified", order, ["host"])
    gap = (F.col("last_modified") - F.col("prev")).cast("interval second")
    seconds = gap.cast("decimal(24,6)").cast("double").alias("gap_seconds")
    return lined.select(*entries.columns, "prev", seconds)


def sort_by_number(
    entries: DataFrame, ascending: bool = True, keys: Sequence[str] = CONTAINER
) -> DataFrame:
    """Entries of each container ranked by their number; the report shows one table each."""
    number = F.expr("try_cast(entry_number AS BIGINT)")
    first = number.asc_nulls_first() if ascending else number.desc_nulls_last()
    return ranked(entries, [first, *map(F.asc, _place(entries))], keys)


def sort_by_text(
    entries: DataFrame, column: str, ascending: bool = True, keys: Sequence[str] = CONTAINER
) -> DataFrame:
    """Entries of each container ranked by lower-cased text; equal texts keep their order."""
    text = F.lower(F.coalesce(F.col(column).cast("string"), F.lit("")))
    first = text.asc() if ascending else text.desc()
    return ranked(entries, [first, *map(F.asc, _place(entries))], keys)


def with_positions(df: DataFrame, keys: Sequence[str] = CONTAINER) -> DataFrame:
    """Adds `position`, the 1-based place of a row in its container's document."""
    return ranked(df, [F.asc("entry_number"), *map(F.asc, _place(df))], keys, into="position")
