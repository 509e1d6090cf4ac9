"""Bounded samples for fitting models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = 1 << 30


def bounded_sample(rows: DataFrame, rank: Column, most: int) -> DataFrame:
    """The `most` rows with the smallest rank, a hash; all rows if there are fewer.

    The rows are counted first and thinned by their rank, so that about twice `most` meet for the final choice
    whatever the size of the table."""
    total = rows.count()
    kept = rows.withColumn("_rank", F.pmod(rank, F.lit(SPAN)))
    if total > 2 * most:
        kept = kept.filter(F.col("_rank") < int(SPAN * 2 * most / total) + 1)
    return kept.orderBy("_rank", *[name for name in rows.columns if name.endswith("id")]).limit(most).drop("_rank")
