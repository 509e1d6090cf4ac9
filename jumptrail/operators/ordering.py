"""Positions and neighbours in a total order, without one task per group.

Rows are laid out in ranges of (keys, order), the one time they are shuffled, and written to the shared folder as a
table bucketed by range, so every later step sees the same ranges even when executors are lost, and finds the rows of
a range together. A key that spans several ranges is stitched together with a table of at most one row per range,
which is what gets broadcast.
The order must end in columns that tell all rows of a key apart.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jumptrail.shared import SMALL, bucketed

_RANGE = "_range"


def _in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    spark = df.sparkSession
    ranges = df.repartitionByRange(*[F.col(key).asc_nulls_first() for key in keys], *order)
    number = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return spark.table(bucketed(ranges.withColumn(_RANGE, F.spark_partition_id()), "ranges", number, [_RANGE], SMALL))


def _stitched(rows: DataFrame, pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of the pieces that continue a key from an earlier range."""
    right = pieces
    for key in [*keys, _RANGE]:
        right = right.withColumnRenamed(key, "_p" + key)
    same = reduce(
        lambda a, b: a & b,
        (F.col(key).eqNullSafe(F.col("_p" + key)) for key in [*keys, _RANGE]),
    )
    return rows.join(F.broadcast(right), same, "left").drop(*("_p" + k for k in [*keys, _RANGE]))


def ranked(
    df: DataFrame, order: Sequence[Column], keys: Sequence[str] = (), into: str = "rank"
) -> DataFrame:
    """Adds the 1-based position of each row within its key (of all rows without keys)."""
    rows = _in_ranges(df, keys, order)
    earlier = Window.partitionBy(*keys).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    pieces = (
        rows.groupBy(*keys, _RANGE)
        .count()
        .withColumn("_before", F.sum("count").over(earlier))
        .filter("_before > 0")
        .drop("count")
    )
    within = F.row_number().over(Window.partitionBy(_RANGE, *keys).orderBy(*order))
    placed = rows.withColumn("_within", within.cast("bigint"))
    position = F.col("_within") + F.coalesce("_before", F.lit(0))
    return (
        _stitched(placed, pieces, keys)
        .withColumn(into, position)
        .drop("_within", "_before", _RANGE)
    )


def with_previous(
    df: DataFrame, value: str, order: Sequence[str], keys: Sequence[str], into: str = "prev"
) -> DataFrame:
    """Adds the value of the row before, in ascending order within the key; null for the first."""
    rows = _in_ranges(df, keys, [F.col(name).asc_nulls_first() for name in order])
    boxed = F.struct(F.col(value))
    across = Window.partitionBy(*keys).orderBy(_RANGE)
    pieces = (
        rows.groupBy(*keys, _RANGE)
        .agg(F.max_by(boxed, F.struct(*order)).alias("_last"))
        .withColumn("_carried", F.lag("_last").over(across))
        .filter("_carried is not null")
        .drop("_last")
    )
    within = Window.partitionBy(_RANGE, *keys).orderBy(*[F.col(n).asc_nulls_first() for n in order])
    placed = rows.withColumn("_near", F.lag(boxed).over(within))
    return (
        _stitched(placed, pieces, keys)
        .withColumn(into, F.coalesce("_near", "_carried")[value])
        .drop("_near", "_carried", _RANGE)
    )
