import pytest
from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.operators import checks as G
from tidemark.specs import Rule


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0].x


@pytest.mark.parametrize("value,want", [(59.9, 0), (60, 1), (89.9, 1), (90, 2), (None, 0)])
def test_level(spark, value, want):
    assert one(spark, X.level(F.lit(value).cast("double"), F.lit(60), F.lit(90))) == want


@pytest.mark.parametrize("a,b,want", [
    ("11.2.0.10", "11.2.1.0", -1), ("11.2", "11.2.0", -1), ("12.1", "11.9.9", 1), ("1.2-3", "1.2-3", 0),
    ("1.2", "1.2-1", -1), ("1.10", "1.9", 1), ("1.2-B", "1.2-a", 1),
])
def test_version_compare(spark, a, b, want):
    assert one(spark, X.version_compare(F.lit(a), F.lit(b))) == want


def test_version_missing_fails(spark):
    assert one(spark, X.version_at_least(F.lit(None).cast("string"), F.lit("1.0"))) is False


@pytest.mark.parametrize("size,want", [
    (0, "0 bytes"), (10239, "10239 bytes"), (10240, "10 kB"), (10 * 1024**2, "10 MB"), (10 * 1024**2 - 1000, "10239 kB"), (None, None),
])
def test_bytes(spark, size, want):
    assert one(spark, X.fmt_bytes(F.lit(size).cast("bigint"))) == want


@pytest.mark.parametrize("seconds,hms,minutes", [(0, "00:00:00", "0.0"), (599, "00:09:59", "10.0"), (600, "00:10:00", "10"), (86399, "23:59:59", "1439")])
def test_durations(spark, seconds, hms, minutes):
    assert one(spark, X.duration_hms(F.lit(seconds))) == hms
    assert one(spark, X.duration_minutes(F.lit(seconds))) == minutes


def test_days(spark):
    assert one(spark, X.duration_days_hms(F.lit(90061))) == "1  Day  01:01:01"


def test_decode_matches_null(spark):
    assert one(spark, X.decode(F.lit(None).cast("string"), {None: "none", "a": "A"}, "?")) == "none"


def test_safe_ratio(spark):
    assert one(spark, X.safe_ratio(F.lit(7), F.lit(0))) == 7.0


def test_host_key(spark):
    assert one(spark, X.host_key(F.lit(" DB01.Example.org"))) == "db01"


STATUS = "host string, io_running string, sql_running string, seconds_behind string, last_error string"


@pytest.mark.parametrize("row,want", [
    (("Yes", "yes", "0", None), 0), (("Yes", "Yes", "1", ""), 1), (("Yes", "Yes", "30", ""), 1), (("Yes", "Yes", "31", ""), 2),
    (("No", "Yes", "0", ""), 2), (("Connecting", "Yes", "0", ""), 1), (("Yes", "Yes", "NULL", ""), 0), (("Yes", "Yes", "0", "bad"), 2),
    ((None, None, None, None), 1),
])
def test_replication(spark, row, want):
    df = spark.createDataFrame([("h", *row)], STATUS)
    assert G.replication_health(df).collect()[0].exit_code == want


LOG = "thread_no int, dest_id int, archived string, applied string, sequence_no bigint, completion_time timestamp_ntz"


@pytest.mark.parametrize("archived,applied,want", [
    (105, 100, "OK!"), (106, 100, "Error! Log Gap is "), (105, None, "OK!"), (None, 100, "Error! Log Gap is "),
])
def test_sequence_gap(spark, archived, applied, want):
    import datetime

    now = datetime.datetime(2024, 1, 1)
    rows = []
    if archived:
        rows.append((1, 1, "YES", "NO", archived, now))
    if applied:
        rows.append((1, 2, "YES", "YES", applied, now))
    assert G.sequence_gap(spark.createDataFrame(rows, LOG)).collect()[0].status == want


def wait_frames(spark, event_micro, db_micro, snaps=2):
    starts = ["2024-01-01"] * snaps
    s = spark.createDataFrame(
        [(1, 1, i, f"2024-01-01 0{i}:00:00", f"2024-01-01 0{i + 1}:00:00", starts[i]) for i in range(snaps)],
        "dbid int, instance_number int, snap_id int, b string, e string, st string",
    ).select("dbid", "instance_number", "snap_id", F.col("b").cast("timestamp_ntz").alias("begin_interval_time"),
             F.col("e").cast("timestamp_ntz").alias("end_interval_time"), F.col("st").cast("timestamp_ntz").alias("startup_time"))
    schema = "dbid int, instance_number int, snap_id int, name string, v bigint"
    last = snaps - 1
    ev = spark.createDataFrame([(1, 1, last - 1, "Io", 0), (1, 1, last, "Io", event_micro)], schema)
    md = spark.createDataFrame([(1, 1, last - 1, "DB time", 0), (1, 1, last, "DB time", db_micro)], schema)
    return (ev.withColumnsRenamed({"name": "event_name", "v": "time_waited_micro"}),
            md.withColumnsRenamed({"name": "stat_name", "v": "value"}), s)


@pytest.mark.parametrize("event_sec,db_sec,pct,status", [
    (2400, 4000, 60.0, "WARNING"), (2399, 4000, 59.98, "OK"), (3600, 4000, 90.0, "WARNING"), (3601, 4000, 90.03, "CRITICAL"),
    (1800, 1800, 50.0, "OK"), (1800, 1801, 99.94, "CRITICAL"),
])
def test_wait_percent(spark, event_sec, db_sec, pct, status):
    frames = wait_frames(spark, event_sec * 10**6, db_sec * 10**6)
    row = G.wait_percent_check(*frames, names=["IO"]).collect()[0]
    assert (row.wait_pct, row.status) == (pct, status)


def test_wait_percent_unknown(spark):
    frames = wait_frames(spark, 10, 10)
    assert G.wait_percent_check(*frames, names=["absent"]).collect()[0].status == "UNKNOWN"
    with pytest.raises(ValueError):
        G.wait_percent_check(*frames, warning=90, critical=60)


def test_gate_compares_numbers(spark):
    seen = spark.range(1).select(F.lit(9))
    rows = {r.rule: r.passed for r in G.gate([(Rule("a", ">", 10), seen), (Rule("b", "<=", 9), seen)]).collect()}
    assert rows == {"a": False, "b": True}


def test_first_match_falls_back(spark):
    rows = spark.createDataFrame([(1, "b=1"), (2, "b=2"), (3, "a=")], "n int, line string")
    got = rows.agg(G.first_match(F.col("line"), ["a=(.*)", "b=(.*)"], F.col("n")).alias("x")).collect()[0].x
    assert got == "2"


@pytest.mark.parametrize("found,configured,verdict,passed", [
    ("a.org", "a.org", "same", True), ("", "(none)", "both empty", False), ("(none)", "a.org", "found empty", False),
    ("a.org", "", "configured empty", True), ("a.org", "b.org", "different", False),
])
def test_domain(spark, found, configured, verdict, passed):
    row = G.domain_audit(spark.createDataFrame([(found, configured)], "found string, configured string")).collect()[0]
    assert (row.verdict, row.passed) == (verdict, passed)


def test_default_version_gate(spark):
    rows = [("cell", "11.2.2.3"), ("cell", "11.2.2"), ("switch", "1.1.3-1"), ("switch", "1.1.4"), ("agent", None), ("other", "1")]
    got = G.version_gate(spark.createDataFrame(rows, "type string, version string")).collect()
    assert {(r.type, r.version): r.passed for r in got} == {
        ("cell", "11.2.2.3"): True, ("cell", "11.2.2"): False, ("switch", "1.1.3-1"): False, ("switch", "1.1.4"): True, ("agent", None): False,
    }
