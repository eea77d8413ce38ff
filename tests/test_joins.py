import random

from pyspark.sql import functions as F

from tidemark.operators import aggregates as A
from tidemark.operators import joins as J


def test_longest_prefix_against_scan(spark):
    draw = random.Random(11)
    parts = ["a", "ab", "b", "c"]
    paths = [(n, "/" + "/".join(draw.choices(parts, k=draw.randint(1, 4)))) for n in range(80)]
    mounts = list({"/" + "/".join(draw.choices(parts, k=draw.randint(1, 2))) for _ in range(8)})
    rows = J.longest_prefix(
        spark.createDataFrame(paths, "id int, path string"), spark.createDataFrame([(m,) for m in mounts], "mount string"),
        ["id"], "path", "mount",
    ).collect()
    want = {}
    for n, path in paths:
        inside = [m for m in mounts if path == m or path.startswith(m + "/")]
        if inside:
            want[n] = max(inside, key=len)
    assert {r.id: r.mount for r in rows} == want


def test_mount_ends_at_a_slash(spark):
    paths = spark.createDataFrame([(1, "/u0x/f"), (2, "/u0/f"), (3, "/")], "id int, path string")
    mounts = spark.createDataFrame([("/u0",)], "mount string")
    assert [r.id for r in J.longest_prefix(paths, mounts, ["id"], "path", "mount").collect()] == [2]


def test_threshold_fallback_compares_numbers(spark):
    facts = spark.createDataFrame([("t", "a"), ("t", "b"), ("u", "a")], "target string, key string")
    limits = spark.createDataFrame(
        [("t", "a", "9"), ("t", " ", "80"), ("t", "a", "10")], "target string, key string, warn string"
    )
    rows = J.threshold_fallback(facts, limits, "target", "key", ["warn"]).collect()
    assert {(r.target, r.key): r.warn for r in rows} == {("t", "a"): 10.0, ("t", "b"): 80.0, ("u", "a"): None}


def test_left_prefiltered_loses_no_row(spark):
    left = spark.range(3)
    right = spark.createDataFrame([(0, 1), (1, 2)], "id bigint, rn int")
    rows = J.left_prefiltered(left, right, ["id"], F.col("rn") == 1).orderBy("id").collect()
    assert [r.rn for r in rows] == [1, None, None]


def test_symmetric_difference_ignores_copies(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",)], "h string")
    b = spark.createDataFrame([("y",), ("z",)], "h string")
    rows = J.symmetric_difference(a, b, ["h"]).collect()
    back = J.symmetric_difference(b, a, ["h"]).collect()
    assert {(r.h, r.missing_in) for r in rows} == {("x", "right"), ("z", "left")}
    assert {r.h for r in rows} == {r.h for r in back}


def test_null_safe_join(spark):
    a = spark.createDataFrame([(None, 1), (2, 2)], "k int, x int")
    b = spark.createDataFrame([(None, 5), (2, 6), (3, 7)], "k int, y int")
    assert sorted((r.x, r.y) for r in J.null_safe_join(a, b, ["k"]).collect()) == [(1, 5), (2, 6)]


def test_percentages_add_up(tables):
    sums = tables.lineitem.groupBy("l_suppkey").agg(F.sum("l_linenumber").alias("v"))
    total = A.percent_of_total(sums, "v").agg(F.sum("pct")).collect()[0][0]
    assert abs(total - 100) < 0.5


def test_member_list_pages_hold_every_member(spark):
    rows = spark.range(100).select(F.lit("k").alias("k"), F.col("id").cast("string").alias("m"))
    lists = A.member_list(rows.union(rows), ["k"], "m", page_size=30, prefix=1).orderBy("page").collect()
    assert [len(r.members.split(",")) for r in lists] == [30, 30, 30, 10]
    assert ",".join(r.members for r in lists).split(",") == sorted(str(n) for n in range(100))


def test_exclusion_lists_say_not_in_at_every_length(spark):
    from tidemark.operators.filters import exclude_values

    rows = spark.createDataFrame([("v1",), ("v500",), (None,)], "c string")
    for size in (5, 100, 101, 400):
        values = [f"v{n}" for n in range(size)]
        assert [r.c for r in exclude_values(rows, "c", values).collect()] == ["v500"]
        assert exclude_values(rows, "c", [*values, None]).count() == 0
    assert exclude_values(rows, "c", []).count() == 3


def test_sketched_distinct_counts_stay_close(tables):
    exact = A.distinct_counts(tables.lineitem, [], ["l_orderkey"]).collect()[0][0]
    near = A.distinct_counts(tables.lineitem, [], ["l_orderkey"], 0.02).collect()[0][0]
    assert abs(near - exact) < 0.1 * exact
