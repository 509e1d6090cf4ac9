"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jumptrail.shared import written


def components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) for every node of the links (columns a and b, longs).

    Each round every node and its present parent hook onto the smallest grandparent among the node's neighbours, so
    long chains shrink geometrically. Each round is written out; the rounds end when no parent changes, which shows in
    their sum since parents only fall. Minima are taken before the shuffle, so a hub is no hot key.
    """
    links = written(links.filter("a <> b").select("a", "b").union(links.filter("a <> b").select("b", "a")).distinct(), "links")
    parents = written(links.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("parent")), "parents")
    before = None
    while True:
        total = parents.agg(F.sum(F.col("parent").cast("decimal(20,0)"))).first()[0]
        if total == before or total is None:
            return parents.select("node", F.col("parent").alias("component"))
        before = total
        grand = parents.join(parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand")), "parent")
        reach = links.join(grand.select(F.col("node").alias("b"), F.col("grand").alias("least")), "b")
        least = written(reach.groupBy(F.col("a").alias("node")).agg(F.min("least").alias("least")), "least")
        hooked = grand.join(least, "node")
        moves = hooked.select(F.col("parent").alias("node"), "least").union(hooked.select("node", F.least("least", "grand")))
        parents = written(moves.groupBy("node").agg(F.min("least").alias("parent")).select("node", F.least("node", "parent").alias("parent")), "parents")
