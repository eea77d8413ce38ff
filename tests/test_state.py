import datetime

import pytest

from tidemark.session import work_folder
from tidemark.specs import CounterSpec
from tidemark.streaming.state import read_kind, start_state_deltas, state_deltas

SPEC = CounterSpec(("k",), ("v",), "v")
SCHEMA = "k string, snap_id bigint, v bigint"


def run(spark, landings, schema=SCHEMA, **options):
    out, state, inbox = (work_folder(spark, n) for n in ("out", "state", "in"))
    progress = []
    for rows in landings:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
        deltas = state_deltas(spark.readStream.schema(schema).parquet(inbox), SPEC, **options)
        query = start_state_deltas(deltas, out, state)
        query.awaitTermination()
        progress.append([p for p in query.recentProgress if p["numInputRows"]][-1])
    kinds = {kind: sorted(((r.k, r.snap_id, r.v) for r in read_kind(spark, out, deltas.schema, kind).collect()), key=str) for kind in ("growth", "late", "repeat")}
    return kinds, progress


def test_late_repeated_and_out_of_order_polls(spark):
    big = 2**60 + 1
    kinds, progress = run(spark, [
        [("a", 3, 9), ("a", 1, 5), ("a", 2, None), ("b", 1, big), (None, 1, 2), ("a", 3, 9)],
        [("a", 4, 10), ("a", 2, 7), ("b", 2, big + 2), ("c", 4, 4), (None, 3, 3), ("n", None, 4), ("a", 0, 1)],
    ], baseline=1)
    assert kinds["growth"] == [("a", 2, None), ("a", 3, 4), ("a", 4, 1), ("b", 2, 2), ("c", 4, 4), (None, 3, 1)]
    assert kinds["late"] == [("a", 0, 1), ("a", 2, 7), ("n", None, 4)] and kinds["repeat"] == [("a", 3, 9)]
    # The second run writes the state of the keys that came, not of all.
    operators = progress[1]["stateOperators"][0]
    assert operators["numRowsUpdated"] <= 4


def test_each_key_begins_with_its_first_poll(spark):
    kinds, _ = run(spark, [[("a", 7, 5), ("b", 8, 1)], [("a", 8, 6), ("b", 9, 0)]])
    assert kinds["growth"] == [("a", 8, 1), ("b", 9, -1)] and not kinds["late"]


def test_repeats_within_the_watermark(spark):
    at = lambda n: datetime.datetime(2024, 1, 1, 0, 0, n)
    schema = "k string, snap_id bigint, v bigint, ts timestamp"
    rows = [("a", 1, 5, at(1)), ("a", 2, 8, at(2))]
    kinds, progress = run(spark, [rows, [*rows, ("a", 3, 9, at(3))]], schema, baseline=1, event_time="ts", late_after="2 seconds")
    assert kinds["growth"] == [("a", 2, 3), ("a", 3, 1)] and not kinds["repeat"]
    with pytest.raises(ValueError):
        state_deltas(spark.createDataFrame(rows, schema), SPEC, event_time="ts")


def test_settings_are_put_back(spark):
    from tidemark.streaming.state import STORE

    before = {name: spark.conf.get(name, None) for name in STORE}
    run(spark, [[("a", 1, 5)]])
    assert {name: spark.conf.get(name, None) for name in STORE} == before
