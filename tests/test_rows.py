import datetime

from pyspark.sql import functions as F

from tidemark.operators import rows as V
from tidemark.operators.filters import as_ntz


def day(n):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)


SCHEMA = "key int, replica int, dc string, payload string, write_ts timestamp_ntz, deleted_at timestamp_ntz, expires_at timestamp_ntz"
AS_OF = "2024-01-31 00:00:00"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_old_tombstone_hides_older_value(spark):
    rows = frame(spark, [
        (1, 1, "d", "v", day(0), None, None), (1, 2, "d", None, day(2), day(2), None),
        (2, 1, "d", "v", day(0), None, None), (2, 2, "d", None, day(25), day(25), None), (3, 1, "d", "v", day(1), None, None),
    ])
    kept = V.compact_versions(rows, ["key"], as_ntz(AS_OF))
    assert {(r.key, r.payload) for r in kept.collect()} == {(2, None), (3, "v")}
    again = V.compact_versions(kept, ["key"], as_ntz(AS_OF))
    assert sorted(map(str, again.collect())) == sorted(map(str, kept.collect()))


def test_expiry_is_exclusive(spark):
    rows = frame(spark, [(1, 1, "d", "v", day(0), None, day(30)), (2, 1, "d", "v", day(0), None, day(31)), (3, 1, "d", "v", day(0), None, None)])
    assert {r.key for r in V.expire(rows, as_ntz(AS_OF)).collect()} == {2, 3}


def test_table_default_is_for_new_rows_only(spark):
    rows = spark.createDataFrame(
        [(1, "t", day(0), None), (2, "t", day(9), None), (3, "t", day(0), 60), (4, "u", day(9), None)],
        "key int, table_name string, write_ts timestamp_ntz, ttl bigint",
    )
    got = {r.key: r.expires_at for r in V.stamp_ttl(rows, {"t": 86400}, as_ntz("2024-01-05 00:00:00")).collect()}
    assert got == {1: None, 2: day(10), 3: day(0) + datetime.timedelta(seconds=60), 4: None}


def replicas(spark):
    return frame(spark, [
        (1, 1, "a", "new", day(2), None, None), (1, 2, "a", "old", day(1), None, None), (1, 3, "b", "new", day(2), None, None),
        (2, 1, "a", "x", day(1), None, None), (2, 2, "a", "x", day(1), None, None), (2, 3, "b", "x", day(1), None, None),
    ])


def test_replica_diff(spark):
    rows = replicas(spark)
    assert [(r.key, r.versions, r.newest_payload) for r in V.replica_diff(rows).collect()] == [(1, 2, "new")]


def test_trace_events_of_one_session(spark):
    rows = spark.createDataFrame([("a", 2, day(1), "y"), ("b", 1, day(1), "n"), ("a", 1, day(1), "x"), ("a", 3, day(0), "w")], "thread string, line_no int, logged_at timestamp_ntz, line string")
    assert [r.line for r in V.trace_events(rows, "a").collect()] == ["w", "x", "y"]


def test_pairs_need_a_finish(spark):
    texts = ["Compacting x", "Compacting y", "Compacted y", "noise", "Compacting z"]
    rows = spark.createDataFrame([("t", i, day(i), s) for i, s in enumerate(texts)], "thread string, line_no int, logged_at timestamp_ntz, line string")
    got = V.pair_durations(rows, "^Compacting ", "^Compacted ", F.floor(F.col("line_no") / 2)).collect()
    assert [(r.line_no, r.seconds) for r in got] == [(1, 86400.0)]
