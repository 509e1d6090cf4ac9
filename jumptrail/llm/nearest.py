"""Approximate nearest neighbours by largest inner product: a hierarchical k-means tree searched best bin first.

The tree is fitted on the driver from a bounded sample (`SAMPLE` vectors with the smallest hash of their id); every
vector is then filed in a leaf. Inner products become distances by one more component that brings all vectors to the
length of the longest. A query walks down to the nearest child and keeps the siblings in a priority queue by the
distance of their centres, so leaves come in order of promise. How many leaves are visited is calibrated: up to
`CALIBRATION` queries are compared with all vectors, and visits widen until their recall reaches `RECALL`; every
query widens further until its leaves hold `4 * k` vectors, so none comes back short.

Queries and leaves meet as blocks: a leaf of many vectors, or one that many queries visit, is split into blocks of
bounded size, each a group of its own. Candidates are picked in a matrix product with a margin and then scored in a
fixed order of summation, so copies of a vector get equal scores and ties go to the smaller id.

Defined results: a vector that is null, empty, all zero or has a null or non-finite component takes no part, nor one
of another length than most; null ids take no part; an id on several rows counts once, with its smallest vector. A
query never finds its own id. Fewer than k candidates give as many rows. An empty table gives an empty table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jumptrail.shared import written

SAMPLE = 20_000
CALIBRATION = 200
RECALL = 0.97
BRANCHES = 8
LEAF = 64  # sample vectors in a leaf, at most
VECTOR_BLOCK = 512
QUERY_BLOCK = 512


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """id and v (doubles) of the vectors that take part, an id once."""
    value = F.col(vector).cast("array<double>")
    good = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(
        value, lambda x: x != 0
    )
    kept = rows.select(F.col(key).cast("long").alias("id"), value.alias("v")).filter(F.col("id").isNotNull() & good)
    kept = written(kept.groupBy("id").agg(F.min("v").alias("v")), "vectors")
    sizes = kept.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    return kept.filter(F.size("v") == (sizes[0]["size"] if sizes else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """A list array of one length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1 if rows else 0)


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors scaled to at most 1, with the component that makes them exactly 1 long."""
    scaled = vectors / longest
    rest = np.sqrt(np.maximum(0.0, 1.0 - (scaled * scaled).sum(axis=1)))
    return np.concatenate((scaled, rest[:, None]), axis=1)


class Tree:
    """Centres of hierarchical k-means; leaves are numbered."""

    def __init__(self, sample: np.ndarray, seed: int = 7) -> None:
        self.random = np.random.default_rng(seed)
        self.leaves = 0
        self.root = self.grow(sample)
        del self.random

    def grow(self, rows: np.ndarray) -> tuple | int:
        """A leaf number, or centres with their subtrees."""
        if len(rows) <= LEAF or (rows == rows[0]).all():
            self.leaves += 1
            return self.leaves - 1
        centres = rows[self.random.choice(len(rows), min(BRANCHES, len(rows)), replace=False)]
        for _ in range(12):
            nearest = closest(rows, centres)
            held = [number for number in range(len(centres)) if (nearest == number).any()]
            centres = np.stack([rows[nearest == number].mean(axis=0) for number in held])
        nearest = closest(rows, centres)
        held = [number for number in range(len(centres)) if (nearest == number).any()]
        if len(held) < 2:
            self.leaves += 1
            return self.leaves - 1
        return centres[held], [self.grow(rows[nearest == number]) for number in held]

    def file(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        found = np.zeros(len(rows), np.int32)

        def walk(node: tuple | int, which: np.ndarray) -> None:
            if isinstance(node, int):
                found[which] = node
                return
            nearest = closest(rows[which], node[0])
            for number, child in enumerate(node[1]):
                if (nearest == number).any():
                    walk(child, which[nearest == number])

        walk(self.root, np.arange(len(rows)))
        return found

    def visits(self, query: np.ndarray) -> Iterator[int]:
        """Leaves in order of promise."""
        queue, tie = [(0.0, 0, self.root)], 0
        while queue:
            _, _, node = heapq.heappop(queue)
            if isinstance(node, int):
                yield node
                continue
            for distance, child in zip(((node[0] - query) ** 2).sum(axis=1).tolist(), node[1]):
                tie += 1
                heapq.heappush(queue, (distance, tie, child))


def closest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(axis=1)[None, :] - 2.0 * rows @ centres.T, axis=1)


def best(query: np.ndarray, vectors: np.ndarray, rough: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple:
    """Positions and exact scores of the k best: largest score, then smallest id."""
    rough = np.where(ids == own, -np.inf, rough)
    if rough.size > k:
        bound = np.partition(rough, rough.size - k)[rough.size - k]
        margin = 1e-9 * (1.0 + np.abs(query).sum() * (np.abs(vectors).max() if vectors.size else 0.0))
        rows = np.flatnonzero((rough >= bound - margin) & (rough > -np.inf))
    else:
        rows = np.flatnonzero(rough > -np.inf)
    scores = (vectors[rows] * query).sum(axis=1)
    order = np.lexsort((ids[rows], -scores))[:k]
    return rows[order], scores[order]


def exact_neighbours(index: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> dict[int, list[int]]:
    """The leaves of the true neighbours of a bounded set of queries, compared with every vector in blocks."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [(np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64))] * len(ids)
        for batch in batches:
            found, leaves, vectors = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2))
            rough = queries @ vectors.T
            for number, own in enumerate(ids):
                rows, scores = best(queries[number], vectors, rough[number], found, own, k)
                score = np.concatenate((kept[number][0], scores))
                other = np.concatenate((kept[number][1], found[rows]))
                leaf = np.concatenate((kept[number][2], leaves[rows]))
                order = np.lexsort((other, -score))[:k]
                kept[number] = score[order], other[order], leaf[order]
        for own, (score, other, leaf) in zip(ids, kept):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(score.size, own)), pa.array(score), pa.array(other), pa.array(leaf.astype(np.int32))],
                ["query", "score", "id", "leaf"],
            )

    rows = index.select("id", "leaf", "v").mapInArrow(scan, "query long, score double, id long, leaf int")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    top = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query", "leaf")
    leaves: dict[int, list[int]] = {}
    for row in top.collect():  # at most CALIBRATION * k rows
        leaves.setdefault(row["query"], []).append(row["leaf"])
    return leaves


def neighbours(
    rows: DataFrame, key: str, vector: str, is_query: str, k: int = 20, recall: float = RECALL
) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest of every row for which the SQL text `is_query` (on `id`)
    holds, among all other rows."""
    spark = rows.sparkSession
    vectors = usable(rows, key, vector)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    longest = vectors.agg(F.max(norm)).first()[0]
    by_hash = (F.xxhash64("id"), F.col("id"))
    sample = vectors.orderBy(*by_hash).limit(SAMPLE).select("v").toArrow().column("v")
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    longest = longest if np.isfinite(longest) else float(np.finfo(np.float64).max) ** 0.5
    tree = Tree(lifted(matrix(sample), longest))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.file(lifted(matrix(batch.column(1)), longest))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(leaf), batch.column(1)], ["id", "leaf", "v"])

    index = written(vectors.select("id", "v").mapInArrow(file, "id long, leaf int, v array<double>"), "leaves")
    sizes = np.zeros(tree.leaves, np.int64)
    for row in index.groupBy("leaf").count().collect():  # a row per leaf; leaves are bounded by the sample
        sizes[row["leaf"]] = row["count"]

    def target(query: np.ndarray) -> np.ndarray:
        length = np.sqrt((query * query).sum())
        return np.append(query / length if 0 < length < np.inf else query / np.abs(query).max(), 0.0)

    queries = index.filter(is_query).select("id", "v")
    tried = queries.orderBy(*by_hash).limit(CALIBRATION).toArrow()
    width = tree.leaves
    if tried.num_rows:
        ids, vs = tried.column("id").to_numpy(), matrix(tried.column("v"))
        truth = exact_neighbours(index, ids, vs, k)
        needed = []
        for own, query in zip(ids, vs):
            place = {leaf: number for number, leaf in enumerate(tree.visits(target(query)))}
            needed += [place[leaf] for leaf in truth.get(int(own), [])]
        needed.sort()
        width = needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))] + 1 if needed else 1

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, leaves = [], []
            for number, query in enumerate(matrix(batch.column(1))):
                seen = visited = 0
                for leaf in tree.visits(target(query)):
                    if visited >= width and seen > 4 * k:
                        break
                    visited += 1
                    seen += int(sizes[leaf])
                    if sizes[leaf]:
                        at.append(number)
                        leaves.append(leaf)
            taken = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(leaves, pa.int32())], ["id", "v", "leaf"])

    routed = written(queries.mapInArrow(route, "id long, v array<double>, leaf int"), "visits")
    asked = routed.groupBy("leaf").agg(F.count("*").alias("asked"))
    blocks = index.groupBy("leaf").agg(F.count("*").alias("held")).join(asked, "leaf").select(
        "leaf",
        F.ceil(F.col("held") / VECTOR_BLOCK).alias("vector_blocks"),
        F.ceil(F.col("asked") / QUERY_BLOCK).alias("query_blocks"),
    )
    blocks = F.broadcast(written(blocks, "blocks"))  # a row per leaf
    other = F.explode(F.sequence(F.lit(0), F.col("many") - 1))
    held = (
        index.join(blocks, "leaf")
        .withColumn("vector_block", F.pmod(F.xxhash64("id"), F.col("vector_blocks")))
        .withColumn("many", F.col("query_blocks"))
        .withColumn("query_block", other)
        .select("leaf", "vector_block", "query_block", "id", "v")
    )
    asking = (
        routed.join(blocks, "leaf")
        .withColumn("query_block", F.pmod(F.xxhash64("id"), F.col("query_blocks")))
        .withColumn("many", F.col("vector_blocks"))
        .withColumn("vector_block", other)
        .select("leaf", "vector_block", "query_block", "id", "v")
    )

    def meet(held: pa.Table, asking: pa.Table) -> pa.Table:
        ids, vs = held.column("id").to_numpy(), matrix(held.column("v"))
        owns, qs = asking.column("id").to_numpy(), matrix(asking.column("v"))
        found: list[tuple] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if len(ids) and len(owns):
            rough = qs @ vs.T
            for number, own in enumerate(owns):
                at, scores = best(qs[number], vs, rough[number], ids, own, k)
                found.append((np.full(at.size, own), ids[at], scores))
        columns = [np.concatenate(column) for column in zip(*found)]
        return pa.table([pa.array(column) for column in columns], ["query_id", "vec_id", "score"])

    block = ["leaf", "vector_block", "query_block"]
    pairs = held.groupBy(*block).cogroup(asking.groupBy(*block)).applyInArrow(
        meet, "query_id long, vec_id long, score double"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", "id % 20 = 0")
