import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions.exprs import version_compare
from tidemark.operators import rules as R
from tidemark.operators.counters import latency_heatmap, latency_matrix
from tidemark.operators.sketches import daily_sketches, rolled_up


def brute(lines, rules):
    out = []
    for key, line in lines:
        for name, needle, pattern in set(rules):
            if None in (line, name, pattern) or (needle or "") not in line:
                continue
            match = re.search(pattern, line)
            if match:
                out.append((key, name, [g or "" for g in match.groups()]))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [20, 1 << 20])
def test_rules_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(R, "MOST_RULE_BYTES", most)
    draw = random.Random(1)
    words = ["alpha", "beta", "bet", "eta", "gamma 7", "ümlaut", "(x)"]
    lines = [(k, " ".join(draw.choice(words) for _ in range(draw.randint(0, 6)))) for k in range(200)] + [(900, None), (901, "")]
    rules = [("r1", "alpha", "alpha (\\\\w+)"), ("r2", "eta", "(b)?eta( gamma)?"), ("r3", "bet", "^bet"), ("r4", "(x)", re.escape("(x)")), ("r5", None, "^$"),
             ("r6", "", "ümlaut$"), ("r1", "beta", "(beta) beta"), (None, "a", "a"), ("r7", "alpha", None), ("r3", "bet", "^bet")]
    rules = [(n, needle, p and p.replace("\\\\", "\\")) for n, needle, p in rules]
    df = spark.createDataFrame([(k, line, "clash") for k, line in lines], "k int, line string, rule string")
    table = spark.createDataFrame(rules, "rule string, needle string, pattern string")
    got = R.match_rules(df, table)
    assert got.columns == ["k", "line", "rule", "groups"]
    assert sorted(((r.k, r.rule, r.groups) for r in got.collect()), key=str) == brute(lines, rules)
    assert R.match_rules(df, table.filter("false")).count() == 0 and R.match_rules(df.filter("false"), table).count() == 0


def test_version_keys_are_in_the_order_of_versions(spark):
    draw = random.Random(2)
    versions = [".".join(str(draw.choice([0, 1, 2, 9, 10, 11, 100])) for _ in range(draw.randint(1, 4))) + draw.choice(["", "", "-1", "-b"]) for _ in range(40)]
    rows = spark.createDataFrame([(a, b) for a in versions for b in versions], "a string, b string")
    key = F.when(R.version_key(F.col("a")) < R.version_key(F.col("b")), -1).when(R.version_key(F.col("a")) > R.version_key(F.col("b")), 1).otherwise(0)
    assert rows.filter(key != version_compare(F.col("a"), F.col("b"))).count() == 0
    rules = spark.createDataFrame([("t", "1.9"), ("t", "1.10"), ("u", None)], "type string, required string")
    found = spark.createDataFrame([("t", "1.9.9"), ("t", "1.10"), ("t", None), ("u", "1")], "type string, version string")
    got = R.version_audit(found, rules).collect()
    assert sorted((str(r.version), r.required, r.passed) for r in got) == [("1.10", "1.10", True), ("1.9.9", "1.10", False), ("None", "1.10", False)]


def test_latencies_between_powers_of_two(spark):
    rows = spark.createDataFrame([(1, 3, 7), (1, 4, 1), (1, 0, 2), (1, 4194305, 5), (1, None, 9), (2, 3, 9), (2, 4, 1)], "snap_id int, wait_time_milli long, wait_count long")
    first = {r.snap_id: r for r in latency_matrix(rows).collect()}
    assert (first[1].b_4, first[1].b_1, first[1].b_over, first[1].b_2) == (8, 2, 5, 0) and first[2].b_4 == 10
    assert {(r.bucket, r.waits) for r in latency_heatmap(rows).filter("snap_id = 2").collect()} == {(4, 2)}


def test_sketches_merge_over_days(spark):
    rows = spark.range(40_000).selectExpr("CAST(id % 10 AS INT) AS d", "id % 3 AS k", "id % 9001 AS who", "CAST(id AS DOUBLE) AS v")
    rows = rows.unionByName(spark.sql("SELECT 3 AS d, 7L AS k, CAST(NULL AS BIGINT) AS who, CAST(NULL AS DOUBLE) AS v"))
    kept = daily_sketches(rows, F.col("d"), ["k"], "who", "v")
    got = {r.k: r for r in rolled_up(kept, ["k"], F.lit(2), F.lit(6)).collect()}
    exact = rows.filter("d BETWEEN 2 AND 6 AND k < 3").groupBy("k").agg(F.count_distinct("who").alias("n"), F.count("*").alias("rows"), F.median("v").alias("m")).collect()
    for r in exact:
        assert got[r.k].rows == r.rows and abs(got[r.k].distinct - r.n) < 0.08 * r.n and abs(got[r.k].p50 - r.m) < 0.02 * 40_000
    assert (got[7].rows, got[7].distinct, got[7].p50) == (1, 0, None)
