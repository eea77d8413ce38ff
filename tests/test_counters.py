import pytest
from pyspark.sql import functions as F

from tidemark.operators import counters as D
from tidemark.specs import COUNTER_SETS, LATENCY_BUCKETS, CounterSpec, Ratio

def chunk():
    return F.floor(F.col("snap") / 2)


@pytest.fixture(scope="module")
def readings(spark):
    # b restarts at 3, c is new at 2, d is gone after 1.
    data = [
        ("a", 1, 10), ("a", 2, 15), ("a", 3, 15), ("b", 1, 7), ("b", 2, 9), ("b", 3, 2), ("b", 4, 6),
        ("c", 2, 4), ("c", 3, 5), ("d", 1, 3),
    ]
    return spark.createDataFrame(data, "k string, snap int, v bigint")


def deltas(readings, **modes):
    out = D.counter_delta(readings, ["k"], ["snap"], ["v"], chunk(), **modes)
    return {(r.k, r.snap): r.v for r in out.collect()}


def test_clamp_and_null(readings):
    got = deltas(readings)
    assert got[("b", 3)] == 0 and got[("a", 2)] == 5 and got[("a", 3)] == 0
    assert got[("a", 1)] is None and got[("c", 2)] is None and ("d", 2) not in got


def test_raw_and_full(readings):
    got = deltas(readings, on_reset="raw", on_new="full")
    assert got[("b", 3)] == -7 and got[("c", 2)] == 4 and got[("a", 1)] == 10


def test_reset_as_null(readings):
    assert deltas(readings, on_reset="null")[("b", 3)] is None


def test_unknown_mode(readings):
    with pytest.raises(ValueError):
        D.counter_delta(readings, ["k"], ["snap"], ["v"], chunk(), on_reset="wrap")


def test_raw_deltas_add_up_to_the_last_value(tables):
    rows = tables.counter_readings
    out = D.counter_delta(rows, ["inst_id", "name"], ["event_id"], ["reading"], 500, "raw", "full")
    sums = out.groupBy("inst_id", "name").agg(F.sum("reading").alias("total"))
    last = rows.groupBy("inst_id", "name").agg(F.max_by("reading", "event_id").alias("last"))
    assert sums.join(last, ["inst_id", "name"]).filter("total <> last").count() == 0


def test_ratio_needs_a_positive_denominator(spark):
    spec = CounterSpec(("k",), ("a", "b"), "a", (Ratio("r", "a", "b", 100.0),))
    rows = spark.createDataFrame([("x", 1, 4), ("y", 1, 0), ("z", 1, -2)], "k string, a int, b int")
    assert {r.k: r.r for r in D.with_ratios(rows, spec).collect()} == {"x": 25.0, "y": 0.0, "z": 0.0}


def test_counter_sets_are_nine_and_consistent():
    assert len(COUNTER_SETS) == 9
    for spec in COUNTER_SETS.values():
        assert spec.sort_by in spec.counters and set(spec.shown_keys) <= set(spec.keys)


def test_latency_matrix_has_24_buckets(spark):
    rows = spark.createDataFrame([(1, 1, 5), (1, 4194304, 2), (1, 8388608, 9)], "snap_id int, wait_time_milli bigint, wait_count bigint")
    row = D.latency_matrix(rows).collect()[0]
    assert len(LATENCY_BUCKETS) + 1 == 24 and (row.b_1, row.b_4194304, row.b_over, row.b_2) == (5, 2, 9, 0)


def test_heatmap_has_no_negative_cell(tables):
    assert D.latency_heatmap(tables.latency_hist).filter("waits < 0").count() == 0


def test_stride_includes_the_last_snapshot(spark):
    rows = spark.sql("""
        SELECT 1 AS dbid, 1 AS instance_number, id AS snap_id, timestamp_ntz'2024-01-01' + make_dt_interval(0, cast(id as int)) AS
        begin_interval_time FROM range(1, 8)""")
    first, last = F.lit("2024-01-01").cast("timestamp_ntz"), F.lit("2024-01-02").cast("timestamp_ntz")
    pairs = D.snapshot_pairs_stride(rows, 3, first, last).orderBy("begin_snap").collect()
    assert [(p.begin_snap, p.end_snap) for p in pairs] == [(1, 4), (4, 7)]
