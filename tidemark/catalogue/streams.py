"""Streaming queries, run to the end of the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.catalogue.counters import spec_check, spec_feed
from tidemark.catalogue.registry import BUILDS, CHECKS, query
from tidemark.operators.counters import spec_report
from tidemark.session import work_folder
from tidemark.specs import COUNTER_SETS
from tidemark.streaming.counters import count_late, read_deltas, stream_counter_delta, stream_top_polls
from tidemark.streaming.state import read_kind, start_state_deltas, state_deltas
from tidemark.streaming.monitor import sliding_hour, stream_monitor

SPEC = COUNTER_SETS["system_event"]


def daily_polls(t):
    return t.counter_snapshots.select(
        "snap_id", "inst_id", F.col("name").alias("event"), F.col("time_waited").alias("time_waited_micro"), "total_waits"
    )


def land(feed: DataFrame, landings, start) -> None:
    """Lands parts of ``feed`` one after the other and runs the query to the end after each.

    ``landings`` are conditions; ``start`` gets the stream and starts the query, and every run but the first resumes
    from the checkpoint.
    """
    spark = feed.sparkSession
    inbox = work_folder(spark, "inbox")
    for condition in landings:
        feed.filter(condition).write.mode("append").parquet(inbox)
        start(spark.readStream.schema(feed.schema).parquet(inbox)).awaitTermination()


GROWTH = """
    SELECT inst_id, name AS event, snap_id, time_waited - coalesce(lag(time_waited) OVER w, 0) AS time_waited_micro,
           total_waits - coalesce(lag(total_waits) OVER w, 0) AS total_waits FROM $counter_snapshots
    WINDOW w AS (PARTITION BY inst_id, name ORDER BY snap_id)"""

#: The days in three landings; in the second, odd and even instances come one after the other.
DAYS = ("snap_id <= 10", "snap_id BETWEEN 11 AND 20 AND inst_id % 2 = 1", "snap_id BETWEEN 11 AND 20 AND inst_id % 2 = 0", "snap_id > 20")


@query("stream_delta", f"SELECT * FROM ({GROWTH}) g WHERE snap_id > 1")
def _(t):
    out, state = work_folder(t.spark, "deltas"), work_folder(t.spark, "state")
    land(daily_polls(t), DAYS, lambda polls: stream_counter_delta(polls, SPEC, out, state, poll_seconds=None))
    return read_deltas(t.spark, out)


@query("stream_delta_late", f"""
    SELECT 'shown' AS kind, count(*) AS n, sum(total_waits)::BIGINT AS total_waits FROM (
        {GROWTH.replace("$counter_snapshots", "(SELECT * FROM $counter_snapshots WHERE snap_id >= 7) c")}) g WHERE snap_id > 7
    UNION ALL SELECT 'late', count(*), sum(total_waits)::BIGINT FROM $counter_snapshots WHERE snap_id BETWEEN 3 AND 6""")
def _(t):
    """A stream that begins at poll 7 and brings polls 3 to 6 when they are late."""
    out, state = work_folder(t.spark, "deltas"), work_folder(t.spark, "state")
    landings = ("snap_id BETWEEN 7 AND 20", "snap_id BETWEEN 3 AND 6", "snap_id > 20")
    land(daily_polls(t), landings, lambda polls: stream_counter_delta(polls, SPEC, out, state, poll_seconds=None))
    kinds = {"shown": read_deltas(t.spark, out), "late": count_late(t.spark, out)}
    return reduce(DataFrame.union, [
        df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.sum("total_waits").alias("total_waits")) for kind, df in kinds.items()
    ])


def run_state(t, landings, **options):
    """The polls in several landings through the state store; (folder, schema) of what was written."""
    out, checkpoint, inbox = work_folder(t.spark, "kinds"), work_folder(t.spark, "state"), work_folder(t.spark, "inbox")
    for feed in landings:
        feed.write.mode("append").parquet(inbox)
        deltas = state_deltas(t.spark.readStream.schema(feed.schema).parquet(inbox), SPEC, **options)
        start_state_deltas(deltas, out, checkpoint).awaitTermination()
    return out, deltas.schema


@query("stream_delta_state", f"SELECT * FROM ({GROWTH}) g WHERE snap_id > 1")
def _(t):
    """As ``stream_delta``, with the last values in the state store."""
    feed = daily_polls(t)
    out, schema = run_state(t, [feed.filter("snap_id <= 12"), feed.filter("snap_id > 12")], baseline=1)
    return read_kind(t.spark, out, schema, "growth")


@query("stream_late_polls", f"""
    SELECT 'growth' AS kind, count(*) AS n, sum(total_waits)::BIGINT AS total_waits FROM (
        {GROWTH.replace("$counter_snapshots", "(SELECT * FROM $counter_snapshots WHERE snap_id >= 7) c")}) g WHERE snap_id > 7
    UNION ALL SELECT 'late', count(*), sum(total_waits)::BIGINT FROM $counter_snapshots WHERE snap_id BETWEEN 5 AND 6
    UNION ALL SELECT 'repeat', count(*), sum(total_waits)::BIGINT FROM $counter_snapshots WHERE snap_id = 20""")
def _(t):
    """Polls from 7 on, out of order within a landing, some twice; the second landing brings 5 and 6 late and 20 again."""
    feed = daily_polls(t)
    first = feed.filter("snap_id BETWEEN 7 AND 20").orderBy(F.desc("snap_id"))
    second = feed.filter("snap_id > 20").unionByName(feed.filter("snap_id IN (5, 6, 20)"))
    out, schema = run_state(t, [first, second], baseline=7)
    return reduce(DataFrame.unionByName, [
        read_kind(t.spark, out, schema, kind).agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.sum("total_waits").alias("total_waits"))
        for kind in ("growth", "late", "repeat")
    ])


@query("stream_topn", f"""
    SELECT snap_id, inst_id, event, time_waited_micro, total_waits, CAST(rank AS INT) AS rank,
           CASE WHEN total_waits > 0 THEN time_waited_micro * 0.001::DOUBLE / total_waits ELSE 0 END AS ms_per_wait FROM (
        SELECT *, row_number() OVER (PARTITION BY snap_id ORDER BY total_waits DESC, inst_id, event) AS rank
        FROM ({GROWTH}) g WHERE snap_id > 1) r WHERE rank <= 10""")
def _(t):
    out, state = work_folder(t.spark, "top"), work_folder(t.spark, "state")
    land(daily_polls(t), DAYS, lambda polls: stream_top_polls(polls, SPEC, out, state, poll_seconds=None))
    return t.spark.read.parquet(f"{out}/top").withColumn("snap_id", F.col("snap_id").cast("bigint"))


def register_stream(kind: str) -> None:
    spec = COUNTER_SETS[kind]

    @query(f"stream_live_{kind}", f"SELECT * FROM ({spec_check(kind)}) s WHERE snap_id > 1")
    def _(t):
        out, state = work_folder(t.spark, "deltas"), work_folder(t.spark, "state")
        feed = t.sql(spec_feed(kind))
        land(feed, ("snap_id <= 12", "snap_id > 12"), lambda polls: stream_counter_delta(polls, spec, out, state, poll_seconds=None))
        deltas = read_deltas(t.spark, out)
        report = spec_report(deltas, spec, ["snap_id"])
        names = {r.name for r in spec.ratios}
        return report.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in report.columns])


for _kind in COUNTER_SETS:
    register_stream(_kind)


class Snapshot:
    """The tables with one of them replaced by what has just arrived."""

    def __init__(self, tables, **arrived: DataFrame):
        self._tables, self._arrived = tables, arrived

    def __getattr__(self, name: str):
        return self._arrived[name] if name in self._arrived else getattr(self._tables, name)


REPORTS = sorted(name for name in BUILDS if name.startswith("rep_h"))


@query("stream_monitor", " UNION ALL ".join(f"SELECT '{name}' AS report, count(*) AS n FROM ({CHECKS[name]}) {name}" for name in REPORTS))
def _(t):
    """All PostgreSQL reports on an arriving snapshot of the activity; the rows each of them kept."""
    activity = t.pg_activity
    folder, out = work_folder(t.spark, "activity"), work_folder(t.spark, "monitor")
    activity.write.parquet(folder)
    stream = t.spark.readStream.schema(activity.schema).parquet(folder)
    reports = {name: (lambda arrived, build=BUILDS[name]: build(Snapshot(t, pg_activity=arrived))) for name in REPORTS}
    stream_monitor(stream, reports, out, work_folder(t.spark, "state"), None).awaitTermination()
    return reduce(DataFrame.union, [
        t.spark.read.parquet(f"{out}/{name}").agg(F.lit(name).alias("report"), F.count("*").alias("n")) for name in REPORTS
    ])


SLIDING = """
    WITH s AS (SELECT time_bucket(INTERVAL 5 MINUTE, sample_time) AS b, sql_id, wait_time FROM $activity_samples)
    SELECT b - i * INTERVAL 5 MINUTE AS window_start, b - i * INTERVAL 5 MINUTE + INTERVAL 1 HOUR AS window_end, sql_id,
           count(*) AS samples, sum(wait_time)::BIGINT AS wait_time FROM s CROSS JOIN range(12) r(i) GROUP BY 1, 2, 3"""


@query("stream_sliding_hour", SLIDING)
def _(t):
    samples = t.activity_samples.select("sample_time", "sql_id", "wait_time")
    folder = work_folder(t.spark, "samples")
    # A last row far ahead moves the watermark past every window, so that all of them are emitted.
    last = samples.agg((F.max("sample_time") + F.expr("INTERVAL 3 HOURS")).alias("sample_time")).select(
        "sample_time", F.lit("end").alias("sql_id"), F.lit(0).cast("bigint").alias("wait_time")
    )
    samples.unionByName(last).write.parquet(folder)
    stream = t.spark.readStream.schema(samples.schema).parquet(folder)
    out = work_folder(t.spark, "windows")
    windows = sliding_hour(stream, "sample_time", ["sql_id"], "wait_time")
    run = windows.writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", work_folder(t.spark, "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    return t.spark.read.parquet(out).filter("sql_id <> 'end'")
