"""Chunked windows and spread joins equal their plain forms, whatever the skew."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.operators.ranking import latest_row, rank_top, top_n_per_group
from tidemark.operators.skew import HOT_BYTES, hot_hashes, lookup_join, semi_lookup, with_neighbour, with_running_total


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(3)
    # One key holds most rows, one is null, and numbers have gaps.
    data = [
        (draw.choice(["hot"] * 6 + ["a", "b", None]), n, draw.randint(-5, 9) if draw.random() > 0.1 else None)
        for n in draw.sample(range(5000), 900)
    ]
    return spark.createDataFrame(data, "k string, n bigint, v bigint").repartition(7).cache()


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


@pytest.fixture
def no_coalesce(spark):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, before)


def largest_share(df):
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(sizes) / sum(sizes)


@pytest.mark.parametrize("width", [1, 17, 1000, 10**6])
@pytest.mark.parametrize("following", [False, True])
def test_neighbour(rows, width, following):
    got = with_neighbour(rows, ["k"], ["n"], ["n", "v"], F.floor(F.col("n") / width), following=following, name="p")
    over = Window.partitionBy("k").orderBy("n")
    step = F.lead if following else F.lag
    want = rows.withColumn("p", step(F.struct("n", "v")).over(over))
    assert same(got, want)


@pytest.mark.parametrize("width", [1, 33, 10**6])
def test_running_total(rows, width):
    got = with_running_total(rows, ["k"], ["n"], F.col("v"), F.floor(F.col("n") / width))
    over = Window.partitionBy("k").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    want = rows.withColumn("running", F.coalesce(F.sum("v").over(over), F.lit(0)))
    assert same(got, want)


def test_chunks_out_of_step_are_an_error(spark):
    rows = spark.createDataFrame([("a", 1, 30), ("a", 2, 10), ("a", 3, 20)], "k string, n int, t int")
    with pytest.raises(Exception, match="chunk decreases"):
        with_neighbour(rows, ["k"], ["n"], ["t"], F.col("t")).collect()
    got = with_neighbour(rows, ["k"], ["n"], ["t"], 2).orderBy("n").collect()
    assert [r.previous and r.previous.t for r in got] == [None, 30, 10]


def test_rows_are_shuffled_once(spark, rows):
    """One exchange for the rows, two for one summary row per stretch, and no join."""
    broadcast, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"
    before = {key: spark.conf.get(key) for key in (broadcast, adaptive)}
    spark.conf.set(broadcast, "-1")
    spark.conf.set(adaptive, "false")
    try:
        wide = rows.withColumn("wide", F.repeat("k", 5))
        for df in (with_neighbour(wide, ["k"], ["n"], ["v"], 100), with_running_total(wide, ["k"], ["n"], F.col("v"), 100)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 3 and "Join" not in plan
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("null_safe", [False, True])
@pytest.mark.parametrize("hot_rows, hot_bytes", [(1, 0), (50, 0), (10**6, 0), (1, HOT_BYTES)])
def test_lookup_join(spark, rows, how, null_safe, hot_rows, hot_bytes):
    lookup = spark.createDataFrame([("hot", 1), ("a", 2), ("a", 4), ("zzz", 3), (None, 9), *[("hot", k) for k in range(60)]], "k string, x int")
    odd = rows.unionByName(rows.limit(5).withColumn("k", F.lit(None).cast("string"))).unionByName(rows.limit(3).withColumn("k", F.lit("zzz")))
    got = lookup_join(odd, lookup, ["k"], how, null_safe, hot_rows, hot_bytes)
    other = lookup.withColumnRenamed("k", "_k")
    plain = odd.join(other, F.col("k").eqNullSafe(F.col("_k")), how).drop("_k") if null_safe else odd.join(lookup, "k", how)
    assert same(got.select(*plain.columns), plain)


@pytest.mark.parametrize("side", ["facts", "lookup", "null"])
def test_lookup_join_deals_one_key_evenly(spark, no_coalesce, side):
    """A key with all rows, in the facts or in the lookup, and rows without a key: no task has a twentieth."""
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "64"}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        key = F.when(F.col("id") < 0, F.lit("never")) if side == "null" else F.lit("hot")
        many = spark.range(64_000, numPartitions=8).select(key.alias("k"), F.col("id").alias("n"))
        few = spark.createDataFrame([("hot", 1), ("cold", 2)], "k string, x int")
        joined = lookup_join(few, many, ["k"], "left", hot_rows=300, hot_bytes=0) if side == "lookup" else lookup_join(many, few, ["k"], "left", hot_rows=300, hot_bytes=0)
        assert joined.count() == (64_001 if side == "lookup" else 64_000)
        assert largest_share(joined) < 0.05
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_hot_hashes_are_few_and_true(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 4 == 0, F.lit("a")).when(F.col("id") % 4 == 1, F.lit(None)).otherwise(F.col("id").cast("string")).alias("k"))
    found = hot_hashes(rows, ["k"], 1000)
    want = {r.h for r in spark.sql("SELECT xxhash64('a') AS h UNION ALL SELECT xxhash64(CAST(NULL AS STRING))").collect()}
    assert set(found) == want and all(parts == 5 for parts in found.values())


def test_lookup_join_kinds(spark, rows):
    with pytest.raises(ValueError):
        lookup_join(rows, rows, ["k"], "full")


def test_semi_lookup(rows):
    wanted = rows.filter("v > 5")
    assert same(semi_lookup(rows, wanted, ["k"]), rows.join(wanted.select("k"), "k", "left_semi"))


@pytest.mark.parametrize("n", [1, 3, 20])
def test_rank_top_keeps_ties(rows, n):
    got = rank_top(rows, F.col("v"), n)
    want = rows.withColumn("rank", F.rank().over(Window.orderBy(F.col("v").desc_nulls_last()))).filter(F.col("rank") <= n)
    assert same(got, want)


def test_top_n_per_group_and_latest_row(rows):
    got = top_n_per_group(rows, ["k"], [F.col("n").desc()], 1).drop("rn")
    assert same(got, latest_row(rows, ["k"], ["n"]))


def test_one_single_key_uses_many_tasks(spark, no_coalesce):
    hot = spark.range(100000).select(F.lit("hot").alias("k"), F.col("id").alias("n"), (F.col("id") % 7).alias("v"))
    chunk = F.floor(F.col("n") / 1000)
    broadcast = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(broadcast)
    spark.conf.set(broadcast, "-1")
    try:
        assert largest_share(with_neighbour(hot, ["k"], ["n"], ["v"], chunk)) < 0.5
        assert largest_share(with_running_total(hot, ["k"], ["n"], F.col("v"), chunk)) < 0.5
        lookup = spark.createDataFrame([("hot", 1)], "k string, x int")
        assert largest_share(lookup_join(hot, lookup, ["k"], hot_rows=1000, hot_bytes=0)) < 0.5
    finally:
        spark.conf.set(broadcast, before)
