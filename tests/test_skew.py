"""Results stay the same when one key holds most rows, and the work is spread."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from jumptrail.operators import lookup
from jumptrail.operators.lookup import hot_keys, join_lookup
from jumptrail.operators.ordering import _in_ranges, ranked, with_previous


@pytest.fixture(scope="module")
def fact(spark):
    """One key with a third of all rows, one null key with a tenth, many rare keys."""
    key = (
        F.when(F.col("id") % 3 == 0, F.lit("hot"))
        .when(F.col("id") % 10 == 1, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("k"), (F.col("id") % 400).cast("string")))
    )
    return spark.range(6000).select("id", key.alias("k"), (F.col("id") % 5).alias("k2"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("hot_in_dim", [True, False])
def test_lookup_equals_plain_join(spark, fact, how, hot_in_dim):
    dim = spark.range(0, 400, 2).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"), F.col("id").alias("v"))
    if hot_in_dim:
        dim = dim.unionByName(spark.createDataFrame([("hot", 7)], "k string, v bigint"))
    got = join_lookup(fact, dim, ["k"], how, min_rows=100)
    want = fact.join(dim, ["k"], how)
    assert got.columns == want.columns
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_lookup_with_two_keys(spark, fact):
    dim = fact.select("k", "k2").distinct().filter("k2 < 3").dropna().withColumn("v", F.length("k"))
    got, want = join_lookup(fact, dim, ["k", "k2"], "left", min_rows=50), fact.join(dim, ["k", "k2"], "left")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_hot_keys_are_bounded_and_repeatable(spark, fact, monkeypatch):
    monkeypatch.setattr(lookup, "HOT_KEYS", 3)
    first, second = (
        {r.k for r in hot_keys(fact.repartition(n), ["k"], 2).collect()} for n in (3, 7)
    )
    assert len(first) == 3 and "hot" in first and None not in first and first == second


def test_more_hot_keys_than_the_bound(spark, fact, monkeypatch):
    monkeypatch.setattr(lookup, "HOT_KEYS", 5)
    dim = fact.select("k").distinct().dropna().withColumn("v", F.length("k"))
    assert len(lookup.hot_hashes(fact, ["k"], 2)) == 5
    for how in ("inner", "left", "left_anti"):
        got, want = join_lookup(fact, dim.filter("k <> 'k8'"), ["k"], how, min_rows=2), fact.join(dim.filter("k <> 'k8'"), ["k"], how)
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_a_table_that_repeats_hot_keys_is_not_broadcast(spark, fact, monkeypatch):
    monkeypatch.setattr(lookup, "HOT_KEYS", 5)
    dim = spark.range(30).select(F.lit("hot").alias("k"), F.col("id").alias("v"))
    got = join_lookup(fact, dim, ["k"], "inner", min_rows=100)
    assert "_hot" not in got._jdf.queryExecution().toString() and got.count() == 2000 * 30


def test_only_sketches_move_before_the_join(spark, fact, monkeypatch):
    wide = spark.range(200_000).select((F.col("id") % 150_000).alias("k")).unionByName(spark.range(60_000).select(F.lit(7).alias("k")))
    assert lookup.hot_hashes(wide, ["k"], 5_000) == [spark.range(1).select(F.xxhash64(F.lit(7).cast("bigint"))).first()[0]]
    assert lookup.hot_hashes(wide, ["k"], 80_000) == []
    plain = join_lookup(wide, spark.range(10).withColumnRenamed("id", "k"), ["k"], "inner")
    assert "Union" not in plain._jdf.queryExecution().analyzed().toString().split("Join")[0]


@pytest.mark.parametrize("keys", [(), ("k",), ("k", "k2")])
def test_rank_equals_window(fact, keys):
    order = [F.desc("k2"), F.asc("id")]
    got = ranked(fact.repartition(6), order, keys)
    whole = Window.partitionBy(*keys).orderBy(*order)
    want = fact.withColumn("rank", F.row_number().over(whole).cast("bigint"))
    assert got.select(want.columns).exceptAll(want).count() == 0 and got.count() == 6000


@pytest.mark.parametrize("keys", [["k"], ["k", "k2"]])
def test_previous_equals_window(fact, keys):
    valued = fact.withColumn("v", F.when(F.col("id") % 4 > 0, F.col("id")))
    got = with_previous(valued.repartition(6), "v", ["id"], keys)
    want = valued.withColumn("prev", F.lag("v").over(Window.partitionBy(*keys).orderBy("id")))
    assert got.select(want.columns).exceptAll(want).count() == 0 and got.count() == 6000


def test_hot_key_is_cut_into_ranges(spark, fact):
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        rows = _in_ranges(fact, ["k"], [F.asc("id")])
        sizes = {r._range: r.n for r in rows.groupBy("_range").agg(F.count("*").alias("n")).collect()}
        pieces = rows.filter("k = 'hot'").select("_range").distinct().count()
        assert len(sizes) == 8 and max(sizes.values()) < 2000 and pieces >= 3
        want = Window.partitionBy("k").orderBy("id")
        got = ranked(fact, [F.asc("id")], ["k"])
        assert got.exceptAll(fact.select("k2", "k", "id", F.row_number().over(want).cast("bigint").alias("rank")).select(got.columns)).count() == 0
        before = fact.withColumn("prev", F.lag("id").over(want))
        got = with_previous(fact, "id", ["id"], ["k"]).select(before.columns)
        assert got.exceptAll(before).count() == 0
    finally:
        spark.conf.unset(coalesce)
