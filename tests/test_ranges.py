import collections
import os
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.partitions import Rewritten, rewrite_partitions
from tidemark.operators.ranges import differing_ranges, range_diff, range_digests
from tidemark.operators.rows import replica_diff

SCHEMA = "a int, b string, v int, w string"


def brute(copies):
    """Copy by copy: rows of each key as a bag."""
    def bag(rows):
        held = collections.defaultdict(collections.Counter)
        for row in rows:
            held[row[:2]][row] += 1
        return held

    names = list(copies)
    first, out = bag(copies[names[0]]), []
    for name in names[1:]:
        own = bag(copies[name])
        for key in {*first, *own}:
            if first.get(key) != own.get(key):
                out.append((name, *key, "missing" if key not in own else "extra" if key not in first else "changed"))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels, bits", [(1, 1), (4, 5), (3, 12)])
def test_range_diff_equals_brute_force(spark, levels, bits):
    draw = random.Random(bits)
    base = [(draw.randrange(60), draw.choice(["x", "y", None]), draw.randrange(3), draw.choice([None, "p", "q"])) for _ in range(200)] + [(None, None, 1, None)] * 2
    copies = {"first": base, "same": draw.sample(base, len(base)), "less": base[7:-1], "more": base + [(999, "x", None, ""), (999, "x", None, None)], "none": []}
    copies["other"] = [(a, b, v + 1 if a == 5 else v, w) for a, b, v, w in base]
    frames = {name: spark.createDataFrame(rows, SCHEMA) for name, rows in copies.items()}
    got = range_diff(frames, ["a", "b"], ["v", "w"], levels, bits)
    assert sorted(map(tuple, got.collect()), key=str) == brute(copies)


def test_only_differing_ranges_are_descended(spark):
    one = spark.range(5000).select("id", F.lit("v").alias("v"))
    two = one.withColumn("v", F.when(F.col("id") == 77, "w").otherwise(F.col("v")))
    kept = {name: range_digests(df, ["id"], ["v"], 3, 4) for name, df in (("one", one), ("two", two))}
    assert differing_ranges(kept["one"], kept["two"], 3, 4).count() == 1
    assert kept["one"].groupBy().sum("rows").first()[0] == 3 * 5000
    got = range_diff({"one": one, "two": two}, ["id"], ["v"], 3, 4, digests=kept)
    assert [tuple(r) for r in got.collect()] == [("two", 77, "changed")]
    with pytest.raises(ValueError):
        range_digests(one, ["id"], ["v"], 8, 8)


def test_replicas_agree_by_their_newest_version(spark):
    schema = "key int, replica int, payload string, write_ts timestamp_ntz, deleted_at timestamp_ntz"
    from tests.test_rows import day

    rows = [(1, r, p, day(n), None) for r in (1, 2) for p, n in (("old", 0), ("new", 1))]  # the same two versions on both
    rows += [(2, 1, "only here", day(0), None), (3, 1, "x", day(0), None), (3, 2, "y", day(1), None), (3, 2, "x", day(0), None)]
    got = replica_diff(spark.createDataFrame(rows, schema))
    assert sorted((r.key, r.versions, r.missing, r.newest_payload) for r in got.collect()) == [(2, 1, 1, "only here"), (3, 2, 0, "y")]


def files(folder):
    return {str(p.relative_to(folder)): (p.stat().st_mtime_ns, p.stat().st_ino) for p in pathlib.Path(folder).rglob("*.parquet")}


def test_rewrite_touches_wanted_partitions_alone(spark, tmp_path):
    folder = str(tmp_path / "table")
    rows = spark.createDataFrame([(1, "a=b/c d%", 5), (2, "a=b/c d%", 5), (3, "p", 5), (4, "p", 1), (5, "q", 1), (6, None, 5), (7, "r:[x]{y}", 5)], "k int, part string, v int")
    rows.write.partitionBy("part").parquet(folder)
    before = files(folder)
    change = lambda df: df.filter("v < 5")
    assert rewrite_partitions(spark, folder, rows.schema, ["part"], F.col("v") >= 5, change) == Rewritten(1, 3)
    left = spark.read.schema(rows.schema).parquet(folder)
    assert sorted((r.k, r.part) for r in left.collect()) == [(4, "p"), (5, "q")]
    after = files(folder)
    assert {n for n in after if n.startswith("part=q")} == {n for n in before if n.startswith("part=q")}
    assert all(after[n] == before[n] for n in after if n.startswith("part=q"))
    assert sorted(d for d in os.listdir(folder) if d.startswith("part=")) == ["part=p", "part=q"]
    assert rewrite_partitions(spark, folder, rows.schema, ["part"], F.col("v") >= 5, change) == Rewritten(0, 0)
    assert files(folder) == after
    with pytest.raises(ValueError):
        rewrite_partitions(spark, folder, rows.schema, ["part"], F.col("v") == 1, lambda df: df.withColumn("part", F.lit("z")))
    assert files(folder) == after
