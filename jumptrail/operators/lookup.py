"""Joins of a large table with one row per key, safe when a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jumptrail.shared import few_rows

# Every task keeps a sketch of at most so many keys, and the sketches are merged; so a key with more than
# 3.5 / TRACKED of all rows is always seen, and counted at most so much too high.
TRACKED = 32_768

# At most this many keys count as hot, which bounds what is broadcast whatever the data size. As no more than
# HOT_KEYS keys can be counted at 1 / HOT_KEYS of the rows or more, a key with more than 2 / HOT_KEYS is among them.
HOT_KEYS = 8_192

# Keys with fewer rows than this are left to the shuffle.
HOT_ROWS = 100_000

# Sketches meet in so many tasks before the last one.
GROUPS = 64

_KEY = "_key"


def _hashed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumn(_KEY, F.xxhash64(*keys))


def hot_hashes(fact: DataFrame, keys: Sequence[str], min_rows: int = HOT_ROWS) -> list[int]:
    """Hashes of the up to HOT_KEYS most frequent keys with so many rows.

    Only sketches move, one for each task at most; the driver gets no more than HOT_KEYS numbers. Two keys of one hash
    count as one, which sends a key of few rows along with a hot one and does no harm.
    """
    some = _hashed(fact.dropna(subset=list(keys)), keys).select(_KEY, (F.spark_partition_id() % GROUPS).alias("_group"))
    sketches = some.groupBy("_group").agg(F.expr(f"approx_top_k_accumulate({_KEY}, {TRACKED})").alias("sketch"))
    whole = sketches.agg(F.expr(f"approx_top_k_combine(sketch, {TRACKED})").alias("sketch"))
    found = whole.select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {TRACKED})")).alias("one")).select("one.item", "one.count")
    top = found.filter(F.col("count") >= min_rows).orderBy(F.desc("count"), "item").limit(HOT_KEYS)
    return [row["item"] for row in top.collect()]


def _marks(fact: DataFrame, hashes: list[int]) -> DataFrame:
    rows = few_rows(fact.sparkSession, f"{_KEY} long", **{_KEY: hashes})
    return F.broadcast(rows.withColumn("_hot", F.lit(True)))


def hot_keys(fact: DataFrame, keys: Sequence[str], min_rows: int = HOT_ROWS) -> DataFrame:
    """Up to HOT_KEYS most frequent keys; ties are settled by their hashes, so it is repeatable."""
    marks = _marks(fact, hot_hashes(fact, keys, min_rows))
    return _hashed(fact.dropna(subset=list(keys)).select(*keys), keys).join(marks, _KEY, "left_semi").drop(_KEY).distinct()


def join_lookup(
    fact: DataFrame,
    dim: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    min_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join with a table that is unique by its keys (inner, left, left_semi or left_anti).

    The keys are sketched first. Without a hot key this is an ordinary join. Otherwise rows of hot keys and of null
    keys never shuffle: they meet a broadcast of the rows of `dim` that have those keys, which are counted first; a
    `dim` that repeats its keys beyond the bound takes the ordinary join. The other rows take the ordinary join too,
    where no key holds a large share. A stream takes it as a whole.
    """
    keys = list(keys)
    hot = [] if fact.isStreaming else hot_hashes(fact, keys, min_rows)
    if not hot:
        return fact.join(dim, keys, how)
    marks = _marks(fact, hot)
    hot_dim = _hashed(dim, keys).join(marks, _KEY, "left_semi").drop(_KEY)
    if how in ("left_semi", "left_anti"):
        hot_dim = hot_dim.select(*keys).distinct()
    if hot_dim.count() > 2 * HOT_KEYS:
        return fact.join(dim, keys, how)
    marked = _hashed(fact, keys).join(marks, _KEY, "left").drop(_KEY)
    no_key = reduce(lambda a, b: a | b, (F.col(key).isNull() for key in keys))
    stays = F.col("_hot").isNotNull() | no_key
    stayed = marked.filter(stays).drop("_hot").join(F.broadcast(hot_dim), keys, how)
    moved = marked.filter(~stays).drop("_hot").join(dim, keys, how)
    return stayed.unionByName(moved)
