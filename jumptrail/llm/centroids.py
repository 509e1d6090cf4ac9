"""Centroid clustering of integer vectors in expressions of the JVM: no Python runs in a task.

Components become integers once and are stored. `zip_with` and `aggregate` sum the squared differences to each
centroid, a literal array in the plan; `array_min` of (distance, cluster) picks the nearest, the smaller number on
ties. One sum per component and a count, over the clusters, are what moves: every task sends at most a row per
cluster, so a vector or a cluster that holds a third of all rows is no hot key. The driver receives at most `k` rows
a round and divides them exactly.

Vectors that are null, have another length, or hold a null, a NaN, an infinity or a component beyond LARGEST take no
part: below it a squared distance always fits a long. A sum of components beyond a long fails the job (the
arithmetic of the session is checked), it never wraps around.

Defined results: repeated rows are clustered each; of vectors that share an id, and so a hash, the smaller one in
component order starts first; a null id is hashed as no digits; with fewer vectors than `k` there are as many
centroids as vectors; a centroid that loses all its vectors stays where it is; an empty table gives an empty table;
columns of other names are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jumptrail.shared import written

SCALE = 256
DIMENSIONS = 64
CLUSTERS = 40
ROUNDS = 5
SALT = "2"
LARGEST = float(1 << 19)

Centroids = list[list[int]]


def integer_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """vec_id and x, the components times the scale, rounded down, of the vectors that take part."""
    x = F.col(value).cast("array<double>")
    fits = F.forall(x, lambda v: v.isNotNull() & (F.abs(v) <= LARGEST))
    whole = F.transform(x, lambda v: F.floor(v * F.lit(float(scale))))
    return vectors.filter((F.size(value) == dimensions) & fits).select(F.col(key).cast("long").alias("vec_id"), whole.alias("x"))


def first_centroids(vectors: DataFrame, k: int = CLUSTERS, salt: str = SALT) -> Centroids:
    """The vectors whose ids have the smallest hashes."""
    hashed = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(row["x"]) for row in vectors.select("x", hashed.alias("h")).orderBy("h", "x").limit(k).collect()]


def _literal(rows: Centroids) -> Column:
    arrays = ", ".join("array(" + ", ".join(f"{value}L" for value in row) + ")" for row in rows)
    return F.expr(f"array({arrays})").cast("array<array<bigint>>")


def nearest(x: Column, centroids: Centroids) -> Column:
    """(distance, cluster) of the nearest centroid; null if there is none."""

    def distance(centroid: Column) -> Column:
        apart = F.zip_with(x, centroid, lambda a, b: a - b)
        return F.aggregate(apart, F.lit(0).cast("long"), lambda total, d: total + d * d)

    every = F.transform(
        _literal(centroids), lambda centroid, i: F.struct(distance(centroid).alias("distance"), i.cast("int").alias("cluster"))
    )
    return F.array_min(every)


def moved(vectors: DataFrame, centroids: Centroids) -> Centroids:
    """Each centroid at the mean of its vectors, rounded down; where it was if it has none."""
    dimensions = len(centroids[0]) if centroids else 0
    sums = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(dimensions)]
    near = vectors.select("x", nearest(F.col("x"), centroids)["cluster"].alias("cluster"))
    after = list(centroids)
    for row in near.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
        after[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(dimensions)]
    return after


def fit(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, salt: str = SALT) -> Centroids:
    """Centroids after some rounds over all vectors, which should be a stored table."""
    centroids = first_centroids(vectors, k, salt)
    for _ in range(rounds if centroids else 0):
        centroids = moved(vectors, centroids)
    return centroids


def centroid_hash(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def assigned(vectors: DataFrame, centroids: Centroids) -> DataFrame:
    """vec_id, cluster and distance of every vector, stored; distances are summed per cluster and over all."""
    near = vectors.select("vec_id", nearest(F.col("x"), centroids).alias("near"))
    near = written(near, "near").select("vec_id", "near.cluster", "near.distance")
    inertia = [0] * len(centroids)
    for row in near.groupBy("cluster").agg(F.sum("distance").alias("total")).collect():
        inertia[row["cluster"]] = row["total"]

    def told(values: list, kind: str) -> Column:
        return F.get(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), F.col("cluster")).alias

    return near.select(
        "vec_id",
        "cluster",
        "distance",
        told(inertia, "bigint")("cluster_inertia"),
        F.lit(sum(inertia)).cast("bigint").alias("inertia"),
        told([centroid_hash(c) for c in centroids], "string")("centroid_sha256"),
    )


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, salt: str = SALT) -> DataFrame:
    """Cluster the embeddings of a table."""
    stored = written(integer_vectors(vectors, dimensions, scale), "vectors")
    return assigned(stored, fit(stored, k, rounds, salt))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _oracle() -> str:
    near = """a{i} AS MATERIALIZED (
  SELECT r, min({{'d': d, 'c': c}}) AS m FROM (
    SELECT v.r, k.c, list_sum(list_transform(list_zip(v.x, k.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
    FROM v CROSS JOIN c{i} k) GROUP BY r)"""
    move = """c{j} AS MATERIALIZED (
  SELECT c{i}.c, coalesce(m.x, c{i}.x) AS x FROM c{i} LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM (
      SELECT a{i}.m.c AS c, g.i, sum(v.x[g.i])::BIGINT AS s, count(*) AS n
      FROM a{i} JOIN v USING (r) CROSS JOIN range(1, 65) g(i) GROUP BY ALL) GROUP BY c) m USING (c))"""
    steps = [
        """v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda e: e IS NOT NULL AND isfinite(e))))""",
        """c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY h, x) - 1)::INT AS c, x FROM (
    SELECT x, sha256('2:' || coalesce(vec_id::VARCHAR, '')) AS h FROM v ORDER BY h, x LIMIT 40))""",
    ]
    for i in range(ROUNDS):
        steps += [near.format(i=i), move.format(i=i, j=i + 1)]
    steps.append(near.format(i=ROUNDS))
    return (
        "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, m.c AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.c))::BIGINT AS cluster_inertia,
  (sum(m.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(k.x, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN v USING (r) JOIN c{ROUNDS} k ON k.c = m.c"""
    )


OP12_SQL = _oracle()
