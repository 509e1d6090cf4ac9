"""MinHash near-duplicates by an LSH forest.

Documents with the same set of shingles become one class first, however many copies there are. A class has a
signature of `PERMUTATIONS` minima; `TREES` orders of the signature are the trees of the forest. Classes that share
the first `DEPTHS[0]` values of an order are a region; a region of more than `DENSE` classes is looked at again under
longer prefixes, so the depth adapts to how crowded a region is. Candidates are first each region's leaders with every
other member, at every depth: the class of the smallest document, and the class whose regions hold the most members
over all trees, which is the text that many copies were made from. Candidates whose signatures agree far too little
are put aside, and the rest are confirmed on their full sets. Members of one region that are then still in
different components go through a second pass: their full sets are filed under their rarest shingles, and prefix,
position and length filters leave the pairs to confirm, so a group of many copies never yields all its pairs.

Defined results: a text without words (or null) has the empty set, no links and is its own component; two rows of one
set are linked whatever their ids; component_id ignores null ids and is null only if all ids reachable are; kept
means doc_id is component_id. Repeated rows are returned each; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jumptrail.llm.components import components
from jumptrail.llm.text_arrays import Words, distinct, mix, raw_bytes, shingles, small_batches
from jumptrail.shared import written

PERMUTATIONS = 128
TREES = 32
DEPTHS = (4, 6, 8)
DENSE = 256
# A pair of similarity s agrees in s * PERMUTATIONS values on average; this many standard deviations less still pass.
DEVIATIONS = 4.5


def factors() -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and summands of the permutations."""
    seeds = mix(np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64))
    return (seeds[:PERMUTATIONS] | np.uint64(1)).astype(np.uint32), seeds[PERMUTATIONS:].astype(np.uint32)


def signature(hashes: np.ndarray, times: np.ndarray, plus: np.ndarray) -> np.ndarray:
    """Smallest image of the set under each permutation of 32-bit values."""
    values = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(times.size, 0xFFFFFFFF, np.uint32)
    for start in range(0, values.size, 2048):
        images = np.multiply.outer(times, values[start : start + 2048])
        images += plus[:, None]
        np.minimum(least, images.min(axis=1), out=least)
    return least.view(np.int32)


def document_key() -> Column:
    return F.xxhash64("doc_id", "text")


def shingle_sets(docs: DataFrame, words: int, keep: str) -> DataFrame:
    """k, the `keep` column and the sorted distinct shingle hashes of each document that has words."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Words()
        for batch in small_batches(batches, 0):
            found, first = hashed(*raw_bytes(batch.column(0)))
            each = [distinct(shingles(found[a:b], words)) for a, b in zip(first, first[1:])]
            ends = np.cumsum([0, *(one.size for one in each)]).astype(np.int32)
            values = pa.ListArray.from_arrays(ends, np.concatenate(each).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(1), values], [keep, "hashes"])

    return docs.select("text", keep).mapInArrow(sets, f"{keep} long, hashes array<long>")


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, k, n (size of the set), node (known by its set; null without words) and signature."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, (times, plus) = Words(), factors()
        for batch in small_batches(batches, 0):
            found, first = hashed(*raw_bytes(batch.column(0)))
            sizes, sums, others, signed = [], [], [], []
            for a, b in zip(first, first[1:]):
                one = distinct(shingles(found[a:b], words))
                sizes.append(one.size)
                sums.append(mix(one).sum(dtype=np.uint64))
                others.append(mix(one ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                signed.append(signature(one, times, plus))
            ends = np.arange(len(signed) + 1, dtype=np.int32) * PERMUTATIONS
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[1:],
                    pa.array(sizes, pa.int64()),
                    pa.array(np.array(sums, np.uint64).view(np.int64)),
                    pa.array(np.array(others, np.uint64).view(np.int64)),
                    pa.ListArray.from_arrays(ends, np.concatenate(signed)),
                ],
                ["doc_id", "k", "n", "h", "g", "signature"],
            )

    rows = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), document_key().alias("k"))
    found = rows.mapInArrow(sign, "doc_id long, k long, n long, h long, g long, signature array<int>")
    return found.withColumn("node", F.when(F.col("n") > 0, F.xxhash64("h", "g", "n"))).drop("h", "g")


def regions(classes: DataFrame, depth: int) -> DataFrame:
    """A row for each class and tree: tree, region (the first `depth` values of the tree's order), member."""
    step = PERMUTATIONS // TREES
    values = [[F.col("signature")[(tree * step + i) % PERMUTATIONS] for i in range(depth)] for tree in range(TREES)]
    prefixes = F.array(*[F.xxhash64(F.lit(tree), *some) for tree, some in enumerate(values)])
    return classes.select(F.posexplode(prefixes).alias("tree", "region"), "member")


def alike_in_size(percent: int) -> Column:
    return F.least("an", "bn") * 100 >= F.greatest("an", "bn") * percent


def alike(both: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets (one, two) are alike: 100 * intersection >= percent * union."""
    same = F.size(F.array_intersect("one", "two"))
    union = F.size("one") + F.size("two") - same
    return both.filter(same * 100 >= union * percent).select("a", "b")


def sets_of(keys: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """k and the full set of each document in keys (column k, unique)."""
    texts = docs.select("text", document_key().alias("k")).join(keys, "k", "left_semi").dropDuplicates(["k"])
    return written(shingle_sets(texts, words, "k"), "sets")


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are alike; those whose signatures agree far too little are put aside first."""
    share = percent / 100
    least = PERMUTATIONS * share - DEVIATIONS * (PERMUTATIONS * share * (1 - share)) ** 0.5
    agree = F.aggregate(
        F.zip_with("as", "bs", lambda x, y: (x == y).cast("int")), F.lit(0), lambda total, same: total + same
    )
    sides = {
        side: classes.select(F.col("node").alias(side), F.col("signature").alias(f"{side}s"), F.col("k").alias(f"{side}k"))
        for side in "ab"
    }
    likely = written(
        pairs.join(sides["a"], "a").join(sides["b"], "b").filter(agree >= int(least)).select("a", "ak", "b", "bk"), "likely"
    )
    wanted = written(likely.select(F.col("ak").alias("k")).union(likely.select("bk")).distinct(), "wanted")
    sets = sets_of(wanted, docs, words)
    return alike(likely.join(sets.toDF("ak", "one"), "ak").join(sets.toDF("bk", "two"), "bk"), percent)


def settled(unsettled: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between different components among the rows of unsettled: node, k, component.

    Every set is filed under the shared ones of its rarest shingles, so many that two sets that are alike have one in
    common; sizes and the place of that shingle in both orders must allow the overlap. A shingle that no other set has
    counts in the order without being filed, so copies that each changed too much on their own never become a pair.
    """
    held = written(unsettled.join(sets_of(unsettled.select("k"), docs, words), "k"), "unsettled")
    tokens = held.select("node", F.explode("hashes").alias("token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("many")).filter("many > 1")
    rare = tokens.join(counts, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("many", "token"))).alias("shared"))
    sized = held.select("node", "component", F.size("hashes").alias("n")).join(rare, "node")
    alone = F.col("n") - F.size("shared")
    length = F.col("n") - F.expr(f"(n * {percent}L + 99) div 100") + 1 - alone
    prefix = F.slice("shared", F.lit(1), F.greatest(length, F.lit(0)).cast("int"))
    rows = sized.select("node", "component", "n", alone.alias("alone"), F.posexplode(prefix).alias("at", "shingle"))
    rows = rows.select("node", "component", "n", F.col("shingle.token").alias("token"), (F.col("alone") + F.col("at")).alias("pos"))
    rows = written(rows, "prefixes")

    one = rows.select("token", *[F.col(name).alias(f"a_{name}") for name in ("node", "component", "n", "pos")])
    two = rows.select("token", *[F.col(name).alias(f"b_{name}") for name in ("node", "component", "n", "pos")])
    overlap = F.expr(f"((a_n + b_n) * {percent}L + {99 + percent}) div {100 + percent}")
    pairs = one.join(two, "token").filter(
        (F.col("a_component") < F.col("b_component"))
        & (F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent)
        & (F.least(F.col("a_n") - F.col("a_pos"), F.col("b_n") - F.col("b_pos")) >= overlap)
    )
    pairs = written(pairs.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct(), "pairs")
    sets = held.select("node", "hashes")
    return alike(pairs.join(sets.toDF("a", "one"), "a").join(sets.toDF("b", "two"), "b"), percent)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document with doc_id and text."""
    signed = written(signatures(docs, words), "signatures")
    classes = written(
        signed.filter("node is not null")
        .groupBy("node")
        .agg(F.min("doc_id").alias("least"), F.min("k").alias("k"), F.max("n").alias("n"), F.first("signature").alias("signature"))
        .withColumn("member", F.struct("least", "node", "n")),
        "classes",
    )

    # First pass: leaders, going deeper where regions are dense. A region of two is a pair without looking twice.
    pairs, crowded, members = [], [], classes
    for depth in DEPTHS:
        rows = regions(members, depth)
        seen = written(
            rows.groupBy("tree", "region")
            .agg(F.count("*").alias("size"), F.min("member").alias("leader"), F.max("member").alias("last"))
            .filter("size > 1"),
            "regions",
        )
        pairs.append(seen.filter("size = 2").select("leader", F.col("last").alias("member")))
        several = rows.join(seen.filter("size > 2").select("tree", "region", "size", "leader"), ["tree", "region"])
        several = written(several, "members")
        pairs.append(several.select("leader", "member"))
        central = several.groupBy(F.col("member.node").alias("node")).agg(F.sum("size").alias("central"))
        ranked = several.withColumn("node", F.col("member.node")).join(written(central, "central"), "node")
        hubs = ranked.groupBy("tree", "region").agg(F.max(F.struct("central", "member")).alias("hub"))
        hubs = written(hubs.select("tree", "region", F.col("hub.member").alias("leader")), "hubs")
        pairs.append(several.drop("leader").join(hubs, ["tree", "region"]).select("leader", "member"))
        crowded.append(several)
        dense = several.filter(F.col("size") > DENSE).select(F.col("member.node").alias("node")).distinct()
        members = classes.join(written(dense, "dense"), "node", "left_semi")

    def distinct_pairs(rows: list[DataFrame]) -> DataFrame:
        flat = reduce(DataFrame.unionByName, rows).select(
            F.col("leader.node").alias("a"), F.col("leader.n").alias("an"), F.col("member.node").alias("b"), F.col("member.n").alias("bn")
        )
        good = flat.filter((F.col("a") != F.col("b")) & alike_in_size(percent))
        return good.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    first = written(distinct_pairs(pairs), "pairs")
    links = written(confirmed(first, classes, docs, words, percent), "links")
    found = written(components(links), "components")

    # Second pass: members of one region that are not in one component yet.
    inside = reduce(DataFrame.unionByName, [one.select("tree", "region", "member") for one in crowded])
    inside = written(
        inside.withColumn("node", F.col("member.node"))
        .join(found, "node", "left")
        .select("tree", "region", "member", F.coalesce("component", "node").alias("component")),
        "inside",
    )
    mixed = inside.groupBy("tree", "region").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = inside.join(written(mixed.filter("low < high").select("tree", "region"), "mixed"), ["tree", "region"], "left_semi")
    unsettled = mixed.select(F.col("member.node").alias("node"), "component").distinct().join(classes.select("node", "k"), "node")
    more = written(settled(written(unsettled, "mixed"), docs, words, percent), "links")
    if not more.isEmpty():
        found = written(components(links.union(more)), "components")

    # Documents whose set or component holds more than themselves; all others are their own component.
    placed = classes.select("node", "least").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    several = signed.filter("node is not null").groupBy("node").agg(F.count("*").alias("rows"))
    shared = written(
        placed.join(smallest, "component").join(several, "node")
        .filter((F.col("rows") > 1) | ~F.col("least").eqNullSafe(F.col("component_id")))
        .select("node", "component_id", F.lit(True).alias("shared")),
        "shared",
    )
    return (
        signed.select("doc_id", F.col("n").alias("n_shingles"), "node")
        .join(shared, "node", "left")
        .select("doc_id", "n_shingles", F.when(F.col("shared"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles at a similarity of 85 percent, as the contract of the query has it."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, percent=85)
