import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.counters import counter_delta
from tidemark.session import work_folder
from tidemark.specs import CounterSpec
from tidemark.streaming.counters import count_late, difference_batch, read_deltas, stream_counter_delta, stream_top_polls
from tidemark.streaming.monitor import sliding_hour

SPEC = CounterSpec(("k",), ("v",), "v")
SCHEMA = "k string, snap_id bigint, v bigint"


def run(spark, polls, start):
    inbox = work_folder(spark, "in")
    for rows in polls:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(inbox)
        start(spark.readStream.schema(SCHEMA).parquet(inbox)).awaitTermination()


@pytest.mark.parametrize("shift", [0, 499])
def test_stream_equals_batch_over_restarts(spark, shift):
    polls = [
        [("a", 1, 5), ("b", 1, 9)], [("a", 2, 7)], [("a", 3, 1), ("b", 3, 10), ("c", 3, 4)],
        [("a", 2, 99), ("c", 4, 4)],
    ]
    polls = [[(k, n + shift, v) for k, n, v in rows] for rows in polls]
    out, state = work_folder(spark, "out"), work_folder(spark, "state")
    run(spark, polls, lambda stream: stream_counter_delta(stream, SPEC, out, state, poll_seconds=None))
    got = {(r.k, r.snap_id): r.v for r in read_deltas(spark, out).collect()}
    # The late poll (a, 2, 99) is dropped and counted; the rest is what the batch operator says after the baseline.
    late = ("a", 2 + shift, 99)
    assert [(r.k, r.snap_id, r.v) for r in count_late(spark, out).collect()] == [late]
    kept = spark.createDataFrame([r for rows in polls for r in rows if r != late], SCHEMA)
    batch = counter_delta(kept, ["k"], ["snap_id"], ["v"], 2, "raw", "full").filter(F.col("snap_id") > 1 + shift)
    assert got == {(r.k, r.snap_id): r.v for r in batch.collect()}
    assert got[("a", 3 + shift)] == -6 and got[("c", 3 + shift)] == 4 and ("a", 2 + shift) in got


def test_a_poll_cut_over_batches_has_one_list(spark):
    polls = [[(k, 1, 0) for k in "abcdef"], [("a", 2, 5), ("b", 2, 9)], [("c", 2, 7), ("d", 2, 1)], [("e", 2, 8), ("a", 3, 6)]]
    out, state = work_folder(spark, "out"), work_folder(spark, "state")
    run(spark, polls, lambda stream: stream_top_polls(stream, SPEC, out, state, 3, poll_seconds=None))
    rows = spark.read.parquet(f"{out}/top").collect()
    assert sorted((r.snap_id, r.rank, r.k) for r in rows) == [(2, 1, "b"), (2, 2, "e"), (2, 3, "c"), (3, 1, "a")]


def test_null_readings_show_nothing(spark):
    first = spark.createDataFrame([("a", 1, 5), (None, 1, 2)], SCHEMA)
    _, state, _ = difference_batch(first, None, SPEC, "snap_id")
    second = spark.createDataFrame([("a", 2, None), ("a", 3, 9), (None, 2, 3), ("n", None, 4)], SCHEMA)
    deltas, last, late = difference_batch(second, state, SPEC, "snap_id")
    assert {(r.k, r.snap_id): r.v for r in deltas.collect()} == {("a", 2): None, ("a", 3): 4, (None, 2): 1}
    assert {(r.k, r.snap_id, r.v) for r in last.collect()} == {("a", 3, 9), (None, 2, 3)} and late.count() == 1


def test_a_row_that_comes_twice_counts_once(spark):
    first = spark.createDataFrame([("a", 1, 5), ("a", 1, 5)], SCHEMA)
    _, state, _ = difference_batch(first, None, SPEC, "snap_id")
    deltas, _, late = difference_batch(spark.createDataFrame([("a", 2, 7), ("a", 2, 7), ("a", 3, 7)], SCHEMA), state, SPEC, "snap_id")
    assert sorted((r.snap_id, r.v) for r in deltas.collect()) == [(2, 2), (3, 0)] and late.count() == 0


def test_sliding_hour_equals_plain_windows(spark):
    draw = random.Random(2)
    rows = spark.createDataFrame([(draw.randrange(20_000), draw.choice("ab"), draw.randrange(9)) for _ in range(300)], "s int, k string, v int")
    rows = rows.select(F.timestamp_seconds("s").alias("ts"), "k", "v")
    got = sliding_hour(rows, "ts", ["k"], "v")
    want = rows.groupBy(F.window("ts", "1 hour", "5 minutes").alias("w"), "k").agg(F.count("*").alias("n"), F.sum("v").alias("v"))
    shown = want.select(F.col("w.start").cast("timestamp_ntz"), F.col("w.end").cast("timestamp_ntz"), "k", "n", "v")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, shown.collect()))


def test_monitor_stops_after_some_polls(spark):
    from tidemark.plans.pg import connections_by_state
    from tidemark.streaming.counters import stop_after
    from tidemark.streaming.monitor import stream_monitor

    inbox, out, state = (work_folder(spark, n) for n in ("in", "out", "state"))
    for n in range(4):
        spark.createDataFrame([(n, "active")], "pid int, state string").coalesce(1).write.mode("append").parquet(inbox)
    stream = spark.readStream.schema("pid int, state string").option("maxFilesPerTrigger", 1).parquet(inbox)
    run = stream_monitor(stream, {"states": connections_by_state}, out, state, seconds=1)
    stop_after(run, 2)
    assert not run.isActive
    assert spark.read.parquet(f"{out}/states").count() >= 2
