"""Counter differencing, snapshot series and threshold checks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.catalogue.registry import query
from tidemark.functions import exprs as X
from tidemark.operators import checks as G
from tidemark.operators import counters as D
from tidemark.operators import graph, waits
from tidemark.operators import rules as R
from tidemark.operators.aggregates import roll_up_key, worst_age
from tidemark.operators.filters import as_ntz
from tidemark.operators.layout import land_series, series_delta
from tidemark.session import work_folder
from tidemark.specs import COUNTER_SETS, LATENCY_BUCKETS, MINIMUM_SCHEMA, CounterSpec, Ratio, Rule

KEYS = ["inst_id", "name"]


# Readings are worked on in stretches of so many events.
STRETCH = 1000

RAW_DELTA = """
    SELECT inst_id, name, event_id, reading - coalesce(lag(reading) OVER
           (PARTITION BY inst_id, name ORDER BY event_id), 0) AS reading FROM $counter_readings"""


@query("delta_raw", RAW_DELTA)
def _(t):
    out = D.counter_delta(t.counter_readings, KEYS, ["event_id"], ["reading"], STRETCH, "raw", "full")
    return out.select("inst_id", "name", "event_id", "reading")


@query("delta_bucketed", RAW_DELTA)
def _(t):
    """As ``delta_raw``, over a table landed in buckets of key and stretch."""
    table, folder = f"readings_{uuid.uuid4().hex}", work_folder(t.spark, "series")
    land_series(t.counter_readings, table, folder, KEYS, "event_id", STRETCH, 16)
    return series_delta(t.spark, table, KEYS, "event_id", ["reading"], "raw", "full").select("inst_id", "name", "event_id", "reading")


@query("delta_clamped", """
    SELECT inst_id, name, event_id, greatest(reading - p, 0) AS reading FROM (
        SELECT *, lag(reading) OVER (PARTITION BY inst_id, name ORDER BY event_id) AS p FROM $counter_readings) r
    WHERE p IS NOT NULL""")
def _(t):
    out = D.counter_delta(t.counter_readings, KEYS, ["event_id"], ["reading"], STRETCH)
    return out.select("inst_id", "name", "event_id", "reading").filter("reading IS NOT NULL")


@query("delta_rate", """
    SELECT inst_id, name, event_id, round((reading - p) / ((epoch_us(ts) - epoch_us(pts)) / 1000000.0), 6) AS rate
    FROM (SELECT *, lag(reading) OVER w AS p, lag(ts) OVER w AS pts FROM $counter_readings
          WINDOW w AS (PARTITION BY inst_id, name ORDER BY event_id)) r""")
def _(t):
    out = D.counter_rate(t.counter_readings, KEYS, "ts", ["event_id"], "reading", STRETCH, on_reset="raw")
    return out.select("inst_id", "name", "event_id", F.round("rate", 6).alias("rate"))


@query("delta_ratio", """
    SELECT inst_id, name, snap_id, total_waits, time_waited,
           CASE WHEN total_waits > 0 THEN round(time_waited / total_waits / 1000, 6) ELSE 0 END AS ms_per_wait
    FROM (SELECT inst_id, name, snap_id, total_waits - coalesce(lag(total_waits) OVER w, 0) AS total_waits,
                 time_waited - coalesce(lag(time_waited) OVER w, 0) AS time_waited FROM $counter_snapshots
          WINDOW w AS (PARTITION BY inst_id, name ORDER BY snap_id)) d""")
def _(t):
    spec = CounterSpec(
        ("inst_id", "name"), ("total_waits", "time_waited"), "total_waits",
        (Ratio("ms_per_wait", "time_waited", "total_waits", 0.001),),
    )
    deltas = D.counter_delta(
        t.counter_snapshots, KEYS, ["snap_id"], spec.counters, F.floor(F.col("snap_id") / 8), "raw", "full"
    )
    out = D.spec_report(deltas, spec, ["snap_id"])
    return out.withColumn("ms_per_wait", F.round("ms_per_wait", 6))


@query("agg_rollup_key", f"SELECT name, sum(reading)::BIGINT AS reading FROM ({RAW_DELTA}) d GROUP BY name")
def _(t):
    deltas = D.counter_delta(t.counter_readings, KEYS, ["event_id"], ["reading"], STRETCH, "raw", "full")
    return roll_up_key(deltas, ["name"], ["reading"])


MATRIX = ", ".join(
    f"sum(CASE WHEN wait_time_milli <= {b} AND wait_time_milli > {b // 2} THEN wait_count ELSE 0 END)::BIGINT AS b_{b}" for b in LATENCY_BUCKETS
)


@query("heat_matrix", f"""
    SELECT snap_id, {MATRIX}, sum(CASE WHEN wait_time_milli > 4194304 THEN wait_count ELSE 0 END)::BIGINT AS b_over
    FROM $latency_hist GROUP BY 1""")
def _(t):
    return D.latency_matrix(t.latency_hist)


@query("heat_delta", """
    SELECT bucket, snap_id, greatest(waits - p, 0)::BIGINT AS waits FROM (
        SELECT *, lag(waits) OVER (PARTITION BY bucket ORDER BY snap_id) AS p FROM (
            SELECT CASE wait_time_milli WHEN 3 THEN 4 ELSE wait_time_milli END AS bucket, snap_id, sum(wait_count) AS waits FROM $latency_hist GROUP BY 1, 2) c) d
    WHERE p IS NOT NULL""")
def _(t):
    return D.latency_heatmap(t.latency_hist, snaps_per_chunk=7)


@query("snap_last_two", """
    SELECT dbid, instance_number, snap_id, CAST(age AS INT) AS age FROM (SELECT *, row_number() OVER
        (PARTITION BY dbid, instance_number ORDER BY end_interval_time DESC) AS age FROM $snapshots) s WHERE age <= 2""")
def _(t):
    return D.last_two_snapshots(t.snapshots).select("dbid", "instance_number", "snap_id", "age")


@query("check_wait_percent", """
    WITH two AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dbid, instance_number
                                       ORDER BY end_interval_time DESC) AS age FROM $snapshots) s WHERE age <= 2),
    ev AS (SELECT e.dbid, e.instance_number, e.event_name AS name, max(CASE WHEN age = 1 THEN time_waited_micro END)
                  - max(CASE WHEN age = 2 THEN time_waited_micro END) AS d
           FROM $event_history e JOIN two USING (dbid, instance_number, snap_id) GROUP BY 1, 2, 3),
    md AS (SELECT m.dbid, m.instance_number, lower(m.stat_name) AS name, max(CASE WHEN age = 1 THEN value END)
                  - max(CASE WHEN age = 2 THEN value END) AS d
           FROM $time_model m JOIN two USING (dbid, instance_number, snap_id) GROUP BY 1, 2, 3),
    found AS (SELECT dbid, instance_number, name, d FROM ev
              UNION ALL SELECT dbid, instance_number, name, d FROM md WHERE name IN ('db time', 'parse time')),
    base AS (SELECT dbid, instance_number, d / 1000000.0 AS db_sec FROM md WHERE name = 'db time'),
    since AS (SELECT dbid, instance_number, count(*) AS n FROM $snapshots s WHERE startup_time =
                  (SELECT max(startup_time) FROM $snapshots x WHERE x.dbid = s.dbid AND x.instance_number = s.instance_number)
              GROUP BY 1, 2),
    names AS (SELECT unnest(['view', 'click', 'parse time', 'no such event']) AS name),
    pct AS (SELECT i.dbid, i.instance_number, names.name, 86400.0::DOUBLE AS elapsed_sec, db_sec,
                   round(found.d / 1000000.0, 2) AS wait_sec, n FROM since i CROSS JOIN names
            LEFT JOIN found USING (dbid, instance_number, name) LEFT JOIN base USING (dbid, instance_number)),
    scored AS (SELECT *, round(wait_sec / CASE WHEN db_sec * 2 > elapsed_sec THEN db_sec ELSE elapsed_sec END * 100, 2)
                      AS wait_pct FROM pct)
    SELECT dbid, instance_number, name, wait_sec, elapsed_sec, db_sec, wait_pct,
           CASE WHEN n < 2 OR wait_pct IS NULL THEN 'UNKNOWN' WHEN wait_pct > 22 THEN 'CRITICAL'
                WHEN wait_pct >= 18 THEN 'WARNING' ELSE 'OK' END AS status FROM scored""")
def _(t):
    names = ["view", "click", "parse time", "no such event"]
    return G.wait_percent_check(t.event_history, t.time_model, t.snapshots, names, 18, 22)


@query("snap_pairs", """
    SELECT * FROM (SELECT dbid, instance_number, snap_id AS begin_snap, lead(snap_id) OVER
        (PARTITION BY dbid, instance_number ORDER BY snap_id) AS end_snap FROM $snapshots
        WHERE snap_id BETWEEN 5 AND 25) s WHERE end_snap IS NOT NULL""")
def _(t):
    return D.snapshot_pairs(t.snapshots, 5, 25, per_chunk=6)


@query("snap_pairs_stride", """
    SELECT * FROM (SELECT dbid, instance_number, snap_id AS begin_snap, lead(snap_id) OVER
        (PARTITION BY dbid, instance_number ORDER BY snap_id) AS end_snap FROM (
            SELECT *, row_number() OVER (PARTITION BY dbid, instance_number ORDER BY snap_id) - 1 AS i FROM $snapshots
            WHERE begin_interval_time >= TIMESTAMP '2024-01-04 00:00:00'
              AND begin_interval_time < TIMESTAMP '2024-01-28 00:00:00') n WHERE i % 3 = 0) s
    WHERE end_snap IS NOT NULL""")
def _(t):
    return D.snapshot_pairs_stride(
        t.snapshots, 3, as_ntz("2024-01-04 00:00:00"), as_ntz("2024-01-27 00:00:00"), per_chunk=6
    )


@query("interval_report", """
    SELECT dbid, instance_number, begin_snap, end_snap, event_name, delta, CAST(rank AS INT) AS rank FROM (
        SELECT p.dbid, p.instance_number, begin_snap, end_snap, a.event_name,
               b.total_waits - a.total_waits AS delta,
               row_number() OVER (PARTITION BY p.dbid, p.instance_number, begin_snap
                                  ORDER BY b.total_waits - a.total_waits DESC, a.event_name) AS rank
        FROM (SELECT dbid, instance_number, snap_id AS begin_snap, lead(snap_id) OVER
                     (PARTITION BY dbid, instance_number ORDER BY snap_id) AS end_snap FROM $snapshots) p
        JOIN $event_history a ON a.dbid = p.dbid AND a.instance_number = p.instance_number AND a.snap_id = begin_snap
        JOIN $event_history b ON b.dbid = p.dbid AND b.instance_number = p.instance_number AND b.snap_id = end_snap
             AND b.event_name = a.event_name) r WHERE rank <= 3""")
def _(t):
    pairs = D.snapshot_pairs(t.snapshots)
    return D.interval_report(t.event_history, pairs, ["event_name"], "total_waits", 3)


@query("snap_catalog", """
    SELECT dbid, instance_number, db_name, host_name, min(snap_id) AS min_snap, max(snap_id) AS max_snap,
           min(begin_interval_time) AS first_begin, max(end_interval_time) AS last_end, count(*) AS snapshots
    FROM $snapshots GROUP BY 1, 2, 3, 4""")
def _(t):
    return D.snapshot_catalog(t.snapshots)


def hms(sql: str) -> str:
    return f"printf('%02d:%02d:%02d', ({sql}) // 3600, (({sql}) % 3600) // 60, ({sql}) % 60)"


def days_hms(sql: str) -> str:
    return f"(({sql}) // 86400) || '  Day  ' || {hms(f'({sql}) % 86400')}"


HMS_OF = f"""
    SELECT {days_hms("min(s)")} AS min_interval, {days_hms("max(s)")} AS max_interval FROM (
        SELECT CAST(epoch(completion_time - first_time) AS BIGINT) AS s FROM $archived_log
        WHERE sequence_no <> (SELECT max(sequence_no) FROM $archived_log)) g"""


@query("gap_extremes", HMS_OF)
def _(t):
    return D.gap_extremes(t.archived_log, "first_time", "completion_time", "sequence_no")


@query("fmt_duration", f"""
    SELECT sid, {hms("last_call_et")} AS hms, CASE WHEN last_call_et < 600 THEN printf('%.1f', round(last_call_et / 60.0::DOUBLE, 1))
           ELSE CAST(last_call_et // 60 AS VARCHAR) END AS minutes FROM $sessions""")
def _(t):
    seconds = F.col("last_call_et")
    return t.sessions.select(
        "sid", X.duration_hms(seconds).alias("hms"), X.duration_minutes(seconds).alias("minutes")
    )


@query("fmt_bytes", """
    SELECT lock_no, CASE WHEN round(b) < 10240 THEN CAST(round(b) AS BIGINT) || ' bytes'
        WHEN round(b / 1024) < 10240 THEN CAST(round(b / 1024) AS BIGINT) || ' kB'
        WHEN round(b / 1048576) < 10240 THEN CAST(round(b / 1048576) AS BIGINT) || ' MB'
        ELSE CAST(round(b / 1073741824) AS BIGINT) || ' GB' END AS size
    FROM (SELECT lock_no, ctime * ctime * ctime * 1.0::DOUBLE AS b FROM $locks) l""")
def _(t):
    cube = F.col("ctime") * F.col("ctime") * F.col("ctime")
    return t.locks.select("lock_no", X.fmt_bytes(cube).alias("size"))


@query("fmt_host", "SELECT event_id, split_part(entity_name, '.', 1) AS host FROM $metric_values")
def _(t):
    return t.metric_values.select("event_id", X.host_short(F.col("entity_name")).alias("host"))


@query("check_exhaustion", """
    SELECT sequence_owner, sequence_name,
           round((last_number - min_value) * 100.0::DOUBLE / greatest(max_value - min_value, 1), 1) AS percent_used
    FROM $sequences WHERE max_value > 0
      AND round((last_number - min_value) * 100.0::DOUBLE / greatest(max_value - min_value, 1), 1) > 90""")
def _(t):
    used = X.exhaustion_pct(F.col("last_number"), F.col("min_value"), F.col("max_value"))
    rows = t.sequences.filter("max_value > 0").withColumn("percent_used", used)
    return rows.filter("percent_used > 90").select("sequence_owner", "sequence_name", "percent_used")


# --- classification


@query("cls_threshold", """
    SELECT event_id, CASE WHEN value >= 80 THEN 2 WHEN value >= 40 THEN 1 ELSE 0 END AS usage_level FROM $events""")
def _(t):
    return t.events.select("event_id", X.level(F.col("value"), F.lit(40), F.lit(80)).alias("usage_level"))


@query("cls_seq_gap", """
    WITH s AS (SELECT thread_no, max(CASE WHEN dest_id = 1 AND archived = 'YES' THEN sequence_no END) AS a,
                      max(CASE WHEN dest_id = 2 AND applied = 'YES' THEN sequence_no END) AS p,
                      max(CASE WHEN dest_id = 2 AND applied = 'YES' THEN completion_time END) AS applied_time
               FROM $archived_log GROUP BY 1)
    SELECT thread_no, applied_time, a - p AS log_gap,
           CASE WHEN a - p > 5 OR (applied_time IS NULL) <> (a - p IS NULL) THEN 'Error! Log Gap is '
                ELSE 'OK!' END AS status FROM s""")
def _(t):
    return G.sequence_gap(t.archived_log)


@query("cls_version_gate", """
    SELECT host, type, version, required, passed FROM (
        SELECT *, CASE type WHEN 'cell' THEN '7.10' WHEN 'switch' THEN '20.3.1' WHEN 'agent' THEN '35.5.1-2' END
                      AS required,
               CASE type WHEN 'cell' THEN (v1, v2, v3, sfx) >= (7, 10, -1, '')
                    WHEN 'switch' THEN (v1, v2, v3, sfx) >= (20, 3, 1, '')
                    WHEN 'agent' THEN (v1, v2, v3, sfx) >= (35, 5, 1, '2') END AS passed FROM $versions) v
    WHERE required IS NOT NULL""")
def _(t):
    gated = G.version_gate(t.versions, {"cell": "7.10", "switch": "20.3.1", "agent": "35.5.1-2"})
    return gated.select("host", "type", "version", "required", "passed")


@query("audit_version_rules", """
    SELECT host, type, version, required, passed FROM (
        SELECT *, CASE type WHEN 'cell' THEN '7.10' WHEN 'switch' THEN '20.3.1' WHEN 'agent' THEN '35.5.1-2' END
                      AS required,
               CASE type WHEN 'cell' THEN (v1, v2, v3, sfx) >= (7, 10, -1, '')
                    WHEN 'switch' THEN (v1, v2, v3, sfx) >= (20, 3, 1, '')
                    WHEN 'agent' THEN (v1, v2, v3, sfx) >= (35, 5, 1, '2') END AS passed FROM $versions) v
    WHERE required IS NOT NULL""")
def _(t):
    """The same gate with the least versions as a table."""
    rules = t.spark.createDataFrame([("cell", "7.10"), ("switch", "20.3.1"), ("agent", "35.5.1-2")], "type string, required string")
    return R.version_audit(t.versions, rules).select("host", "type", "version", "required", "passed")


@query("cls_schema_gate", """
    SELECT host, type, version, CASE type WHEN 'catalog' THEN '868' ELSE '502' END AS required,
           schema_no >= CASE type WHEN 'catalog' THEN 868 ELSE 502 END AS passed FROM $component_schemas""")
def _(t):
    gated = G.version_gate(t.component_schemas, MINIMUM_SCHEMA)
    return gated.select("host", "type", "version", "required", "passed")


@query("cls_first_match", r"""
    SELECT node, coalesce(
        max_by(regexp_extract(line, 'no such role is ([0-9]+)', 1), CASE WHEN regexp_matches(line, 'no such role is [0-9]') THEN line_no END),
        max_by(CASE WHEN regexp_matches(line, 'registry writer is node number ([0-9]+) now')
                    THEN regexp_extract(line, 'registry writer is node number ([0-9]+) now', 1) END,
               CASE WHEN regexp_matches(line, 'registry writer is node number ([0-9]+) now') THEN line_no END)) AS writer
    FROM $log_lines GROUP BY node""")
def _(t):
    patterns = ["no such role is ([0-9]+)", "registry writer is node number ([0-9]+) now", "owner is node ([0-9]+)"]
    found = G.first_match(F.col("line"), patterns, F.col("line_no"))
    return t.log_lines.groupBy("node").agg(found.alias("writer"))


@query("cls_readiness_gate", """
    SELECT 'worst full copy in days' AS rule, max(round(epoch(TIMESTAMP '2001-09-01 00:00:00' - d) / 86400.0, 0))::DOUBLE
           AS observed, '<=' AS comparison, 6.0::DOUBLE AS required,
           max(round(epoch(TIMESTAMP '2001-09-01 00:00:00' - d) / 86400.0, 0)) <= 6 AS passed
    FROM (SELECT l_partkey, max(l_shipdate) AS d FROM $lineitem GROUP BY 1) m
    UNION ALL SELECT 'invalid objects', count(*)::DOUBLE, '=', 0.0, count(*) = 0 FROM $objects WHERE status = 'INVALID'
    UNION ALL SELECT 'free space in bytes', sum(bytes)::DOUBLE, '>=', 5368709120.0, sum(bytes) >= 5368709120 FROM $segments""")
def _(t):
    return G.gate([
        (Rule("worst full copy in days", "<=", 6),
         worst_age(t.lineitem, ["l_partkey"], "l_shipdate", as_ntz("2001-09-01 00:00:00"))),
        (Rule("invalid objects", "=", 0), t.objects.filter("status = 'INVALID'").agg(F.count("*"))),
        (Rule("free space in bytes", ">=", 5 * 2**30), t.segments.agg(F.sum("bytes"))),
    ])


@query("cls_gate_scan", """
    SELECT 'segments in bytes' AS rule, sum(bytes)::DOUBLE AS observed, '>=' AS comparison, 5368709120.0::DOUBLE AS required, sum(bytes) >= 5368709120 AS passed FROM $segments
    UNION ALL SELECT 'largest segment', max(bytes)::DOUBLE, '<=', 536870912.0, max(bytes) <= 536870912 FROM $segments
    UNION ALL SELECT 'empty segments', count(*) FILTER (WHERE bytes = 0)::DOUBLE, '=', 0.0, count(*) FILTER (WHERE bytes = 0) = 0 FROM $segments
    UNION ALL SELECT 'invalid objects', count(*) FILTER (WHERE status = 'INVALID')::DOUBLE, '=', 0.0, count(*) FILTER (WHERE status = 'INVALID') = 0 FROM $objects
    UNION ALL SELECT 'objects', count(*)::DOUBLE, '>', 10.0, count(*) > 10 FROM $objects""")
def _(t):
    return G.gate_scan([
        (t.segments, [
            (Rule("segments in bytes", ">=", 5 * 2**30), F.sum("bytes")), (Rule("largest segment", "<=", 2**29), F.max("bytes")),
            (Rule("empty segments", "=", 0), F.count_if(F.col("bytes") == 0)),
        ]),
        (t.objects, [(Rule("invalid objects", "=", 0), F.count_if(F.col("status") == "INVALID")), (Rule("objects", ">", 10), F.count("*"))]),
    ])


# --- waits between sessions

LK = """(SELECT blocking_instance || '.' || blocking_session AS blocker, inst_id || '.' || sid AS waiter
         FROM $sessions WHERE blocking_session IS NOT NULL)"""
TREE = f"""
    WITH RECURSIVE tree AS (
        SELECT DISTINCT blocker AS waiter, blocker AS root, 1 AS level, blocker AS path FROM {LK} r
        WHERE blocker NOT IN (SELECT waiter FROM {LK} w)
        UNION ALL SELECT e.waiter, tree.root, tree.level + 1, tree.path || '/' || e.waiter
        FROM tree JOIN {LK} e ON e.blocker = tree.waiter)
    SELECT repeat('  ', level - 1) || waiter AS lock_tree, waiter, level, root, path FROM tree"""


def tree_edges(t):
    return t.sessions.filter("blocking_session IS NOT NULL").select(
        F.concat("blocking_instance", F.lit("."), "blocking_session").alias("blocker"),
        F.concat("inst_id", F.lit("."), "sid").alias("waiter"),
    )


@query("graph_blocking_tree", TREE)
def _(t):
    return graph.blocking_tree(tree_edges(t)).orderBy("path")


REACH = """
    WITH RECURSIVE e AS (SELECT DISTINCT blocker, waiter FROM $wait_edges w),
    reach AS (SELECT waiter AS x, blocker AS y FROM e UNION SELECT r.x, e.blocker FROM reach r JOIN e ON e.waiter = r.y)"""


@query("graph_wait_cycles", REACH + """
    , pairs AS (SELECT a.x, a.y FROM reach a JOIN reach b ON b.x = a.y AND b.y = a.x)
    SELECT min(y) AS circle, x AS waiter, count(*) AS n_waiters FROM pairs GROUP BY 2""")
def _(t):
    return waits.wait_cycles(t.wait_edges)


@query("graph_wait_tree", REACH + """
    SELECT e.blocker, e.waiter, (SELECT count(*) FROM e o WHERE o.waiter = e.waiter) AS n_blockers,
           e.blocker NOT IN (SELECT waiter FROM e) OR e.blocker IN (SELECT x FROM reach WHERE y NOT IN (SELECT waiter FROM e)) AS placed
    FROM e UNION ALL SELECT NULL, blocker, 0, true FROM (SELECT DISTINCT blocker FROM e WHERE blocker NOT IN (SELECT waiter FROM e)) r""")
def _(t):
    rows = waits.wait_tree(t.wait_edges)
    return rows.select("blocker", "waiter", "n_blockers", F.col("path").isNotNull().alias("placed"))


RESOURCE = ["lock_type", "id1", "id2"]
BLOCKED = """
    SELECT w.lock_type, w.id1, w.id2, w.inst_id AS waiter_inst_id, w.sid AS waiter_sid,
           (array_agg(h.inst_id ORDER BY h.ctime DESC, h.inst_id, h.sid))[1] AS blocker_inst_id,
           (array_agg(h.sid ORDER BY h.ctime DESC, h.inst_id, h.sid))[1] AS blocker_sid, count(*) AS n_blockers
    FROM (SELECT DISTINCT lock_type, id1, id2, inst_id, sid FROM $cluster_locks WHERE request > 0) w
    JOIN (SELECT lock_type, id1, id2, inst_id, sid, max(ctime) AS ctime FROM $cluster_locks WHERE is_blocking = 1 GROUP BY ALL) h
      ON h.lock_type = w.lock_type AND h.id1 = w.id1 AND h.id2 = w.id2 AND (h.inst_id <> w.inst_id OR h.sid <> w.sid)
    GROUP BY 1, 2, 3, 4, 5"""


@query("graph_blocking_pairs", BLOCKED)
def _(t):
    return graph.blocked_by(
        t.cluster_locks, RESOURCE, ["inst_id", "sid"], "is_blocking = 1", "request > 0", ["ctime", "inst_id", "sid"]
    )


@query("join_theta_residual", """
    WITH h AS (SELECT DISTINCT transactionid, pid FROM $pg_locks WHERE granted AND transactionid IS NOT NULL),
    w AS (SELECT DISTINCT transactionid, pid FROM $pg_locks WHERE NOT granted AND transactionid IS NOT NULL)
    SELECT w.transactionid, w.pid AS waiter, min(h.pid) AS blocker, count(*) AS n_blockers
    FROM w JOIN h ON h.transactionid = w.transactionid AND h.pid <> w.pid GROUP BY 1, 2""")
def _(t):
    locks = t.pg_locks.filter("transactionid IS NOT NULL")
    return graph.blocked_by(locks, ["transactionid"], "pid", "granted", "NOT granted", ["pid"])


IDENTITY = [
    "locktype", "database", "relation", "page", "tuple", "virtualxid", "transactionid", "classid", "objid", "objsubid",
]
SAME = " AND ".join(f"h.{c} IS NOT DISTINCT FROM w.{c}" for c in IDENTITY)


@query("join_null_safe", f"""
    WITH h AS (SELECT DISTINCT {", ".join(IDENTITY)}, pid FROM $pg_locks WHERE granted),
    w AS (SELECT DISTINCT {", ".join(IDENTITY)}, pid FROM $pg_locks WHERE NOT granted)
    SELECT w.locktype, w.relation, w.transactionid, w.pid AS waiter, min(h.pid) AS blocker, count(*) AS n_blockers
    FROM w JOIN h ON {SAME} AND h.pid <> w.pid GROUP BY 1, 2, 3, 4""")
def _(t):
    found = graph.blocked_by(t.pg_locks, IDENTITY, "pid", "granted", "NOT granted", ["pid"])
    return found.select("locktype", "relation", "transactionid", "waiter", "blocker", "n_blockers")


@query("graph_contended_locks", """
    WITH r AS (SELECT DISTINCT lock_type, id1, id2, sid, CASE WHEN is_blocking = 1 THEN 'holder' ELSE 'waiter' END AS role
               FROM $locks WHERE is_blocking = 1 OR request > 0)
    SELECT r.*, holders, waiters FROM r JOIN (
        SELECT lock_type, id1, id2, sum(CASE WHEN role = 'holder' THEN 1 ELSE 0 END)::BIGINT AS holders,
               sum(CASE WHEN role = 'waiter' THEN 1 ELSE 0 END)::BIGINT AS waiters FROM r GROUP BY 1, 2, 3) s
    USING (lock_type, id1, id2) WHERE holders > 0 AND waiters > 0""")
def _(t):
    return graph.contended_locks(t.locks, RESOURCE, "sid", "is_blocking = 1", "request > 0")


@query("graph_wait_chains", """
    SELECT * FROM $wait_chains WHERE num_waiters > 0 OR (blocker IS NOT NULL AND in_wait_secs > 10)
    ORDER BY chain_id, num_waiters DESC, waiter LIMIT 100""")
def _(t):
    return graph.wait_chains(t.wait_chains)


# --- the nine counter sets on daily feeds

ONE_SET = {
    "sysstat": ("inst_id, name", {"value": "time_waited"}),
    "system_event": ("inst_id, name AS event", {"time_waited_micro": "time_waited", "total_waits": "total_waits"}),
    "sess_event": (
        "inst_id, 'sql' || inst_id AS sql_id, name AS event, sid, sid * 3 AS serial_no",
        {"time_waited_micro": "time_waited * sid", "total_waits": "total_waits + sid"}),
    "sess_stat": (
        "inst_id, 'sql' || inst_id AS sql_id, name, sid, sid * 3 AS serial_no",
        {"value": "time_waited * sid"}),
    "event_histogram": ("inst_id, name AS event, inst_id * 2 AS wait_time_milli", {"wait_count": "total_waits"}),
    "sgastat": ("inst_id, name AS pool, 'p' || name AS name", {"bytes": "time_waited"}),
    "librarycache": ("inst_id, name AS namespace", {
        "reloads": "total_waits", "invalidations": "total_waits * 2", "gets": "time_waited + 1",
        "gethits": "time_waited", "pins": "time_waited * 3", "pinhits": "time_waited * 2"}),
    "segments_stats": (
        "inst_id, 'o' || inst_id AS owner, name AS object_name, 'reads' AS statistic_name, inst_id AS dataobj_id",
        {"value": "time_waited"}),
    "enqueue_statistics": ("inst_id, name AS eq_name, 'TX' AS eq_type, 'contention' AS req_reason", {
        "total_req": "total_waits", "total_wait": "time_waited", "succ_req": "total_waits",
        "failed_req": "total_waits * 0", "cum_wait_time": "time_waited * 2"}),
}


def spec_feed(kind: str) -> str:
    """Daily values of one counter set as SQL."""
    keys, counters = ONE_SET[kind]
    values = ", ".join(f"CAST({sql} AS BIGINT) AS {name}" for name, sql in counters.items())
    source = "$counter_snapshots"
    if "sid" in COUNTER_SETS[kind].keys:  # three sessions run each statement
        source = "(" + " UNION ALL ".join(f"SELECT *, {sid} AS sid FROM $counter_snapshots" for sid in (1, 2, 3)) + ") s"
    return f"SELECT snap_id, {keys}, {values} FROM {source}"


def spec_check(kind: str) -> str:
    spec = COUNTER_SETS[kind]
    over = f"OVER (PARTITION BY {', '.join(spec.keys)} ORDER BY snap_id)"
    deltas = ", ".join(f"{c} - coalesce(lag({c}) {over}, 0) AS {c}" for c in spec.counters)
    shown = ", ".join(spec.shown_keys)
    sums = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in spec.counters)
    ratios = "".join(
        f", CASE WHEN {r.denominator} > 0 THEN round({r.numerator} * {r.scale}::DOUBLE / {r.denominator}, 6) "
        f"ELSE 0 END AS {r.name}" for r in spec.ratios
    )
    return f"""
        SELECT *{ratios} FROM (SELECT snap_id, {shown}, {sums} FROM (
            SELECT snap_id, {", ".join(spec.keys)}, {deltas} FROM ({spec_feed(kind)}) f) d
            GROUP BY snap_id, {shown}) s"""


def register_spec(kind: str) -> None:
    spec = COUNTER_SETS[kind]

    @query(f"stream_spec_{kind}", spec_check(kind))
    def _(t):
        chunk = F.floor(F.col("snap_id") / 8)
        feed = t.sql(spec_feed(kind))
        deltas = D.counter_delta(feed, spec.keys, ["snap_id"], spec.counters, chunk, "raw", "full")
        report = D.spec_report(deltas, spec, ["snap_id"])
        return report.select(*[
            F.round(c, 6).alias(c) if c in {r.name for r in spec.ratios} else F.col(c) for c in report.columns
        ])


for _kind in COUNTER_SETS:
    register_spec(_kind)
