"""PostgreSQL health reports on derived telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalogue.registry import query
from tidemark.operators.filters import as_ntz
from tidemark.plans import pg as H

NOW = "2024-01-31 00:00:00"


def age(column: str) -> str:
    return f"(epoch_us(TIMESTAMP '{NOW}') - epoch_us({column})) / 1000000.0::DOUBLE"


def pretty(b: str) -> str:
    """A size as text, in the first unit that keeps it below 10240."""
    steps = " ".join(
        f"WHEN round({b} / {1024**p}::DOUBLE) < 10240 THEN CAST(round({b} / {1024**p}::DOUBLE) AS BIGINT) || ' {unit}'"
        for p, unit in enumerate(("bytes", "kB", "MB", "GB", "TB"))
    )
    return f"CASE {steps} END"


@query("rep_h01", f"""
    SELECT owner AS database_name, bytes, {pretty("bytes")} AS size FROM (SELECT owner, sum(bytes)::BIGINT AS bytes FROM $segments GROUP BY 1) s""")
def _(t):
    return H.database_sizes(t.segments, "owner", "bytes")


@query("rep_h02", "SELECT state, usename, count(*) AS n FROM $pg_activity WHERE pid <> 7 GROUP BY 1, 2")
def _(t):
    return H.sessions_by_state(t.pg_activity, 7)


SIDES = f"""
    a.usename AS blocked_user, a.query AS blocked_statement, {age("a.query_start")} AS blocked_duration,
    k.usename AS blocking_user, k.query AS blocking_statement, {age("k.query_start")} AS blocking_duration"""


@query("rep_h03", f"""
    WITH p AS (SELECT b.transactionid, b.pid AS blocked_pid, min(k.pid) AS blocking_pid, count(DISTINCT k.pid) AS n_blockers
               FROM $pg_locks b JOIN $pg_locks k ON k.transactionid = b.transactionid AND k.pid <> b.pid AND k.granted
               WHERE NOT b.granted GROUP BY 1, 2)
    SELECT p.*, {SIDES} FROM p JOIN $pg_activity a ON a.pid = blocked_pid JOIN $pg_activity k ON k.pid = blocking_pid""")
def _(t):
    return H.blocking_by_transaction(t.pg_locks, t.pg_activity, as_ntz(NOW))


SAME = " AND ".join(f"k.{c} IS NOT DISTINCT FROM b.{c}" for c in H.LOCK_IDENTITY)


@query("rep_h04", f"""
    WITH p AS (SELECT {", ".join(f"b.{c}" for c in H.LOCK_IDENTITY)}, b.pid AS blocked_pid, min(k.pid) AS blocking_pid,
                      count(DISTINCT k.pid) AS n_blockers
               FROM $pg_locks b JOIN $pg_locks k ON {SAME} AND k.pid <> b.pid AND k.granted
               WHERE NOT b.granted GROUP BY ALL)
    SELECT locktype, relation, transactionid, blocked_pid, blocking_pid, n_blockers, {SIDES}
    FROM p JOIN $pg_activity a ON a.pid = blocked_pid JOIN $pg_activity k ON k.pid = blocking_pid""")
def _(t):
    empty = ("database", "page", "tuple", "virtualxid", "classid", "objid", "objsubid")
    return H.blocking_by_identity(t.pg_locks, t.pg_activity, as_ntz(NOW)).drop(*empty)


@query("rep_h05", "SELECT schemaname, relname, n_live_tup, n_dead_tup FROM $pg_user_tables ORDER BY n_dead_tup DESC, relname LIMIT 30")
def _(t):
    return H.dead_rows(t.pg_user_tables, ["schemaname", "relname", "n_live_tup", "n_dead_tup"], 30)


@query("rep_h06", f"""
    SELECT 'running' AS list, pid, query, state, {age("xact_start")} AS duration FROM $pg_activity WHERE query LIKE 'autovacuum:%'
    UNION ALL SELECT 'over two minutes', pid, query, state, {age("xact_start")} FROM $pg_activity
    WHERE query LIKE 'autovacuum:%' AND state = 'active' AND query_start < TIMESTAMP '{NOW}' - INTERVAL 2 MINUTE""")
def _(t):
    everyone = H.maintenance_running(t.pg_activity, as_ntz(NOW)).withColumn("list", F.lit("running"))
    slow = H.maintenance_running(t.pg_activity, as_ntz(NOW), 120).withColumn("list", F.lit("over two minutes"))
    return everyone.unionByName(slow)


@query("rep_h07", f"""
    SELECT pid, {age("query_start")} AS duration, query, state FROM $pg_activity
    WHERE state NOT IN ('idle', 'idle in transaction') AND {age("query_start")} > 1 AND query NOT LIKE 'autovacuum:%'""")
def _(t):
    return H.running_statements(t.pg_activity, as_ntz(NOW))


@query("rep_h08", "SELECT state, count(*) AS n FROM $pg_activity GROUP BY 1")
def _(t):
    return H.connections_by_state(t.pg_activity)


@query("rep_h09", "SELECT relname, last_vacuum, last_analyze FROM $pg_user_tables")
def _(t):
    return H.maintenance_times(t.pg_user_tables)


USER_RELATIONS = """
    $pg_class c LEFT JOIN $pg_namespace n ON n.oid = c.relnamespace WHERE nspname NOT IN ('pg_catalog', 'information_schema')"""


@query("rep_h10", f"""
    SELECT nspname, relname, relkind, {pretty("table_bytes")} AS size, {pretty("index_bytes")} AS idxsize,
           {pretty("(table_bytes + index_bytes)")} AS total, table_bytes + index_bytes AS total_bytes
    FROM {USER_RELATIONS} AND nspname NOT LIKE 'pg_toast%' AND relkind IN ('r', 'i') ORDER BY total_bytes DESC, relname LIMIT 20""")
def _(t):
    return H.largest_with_indexes(t.pg_class, t.pg_namespace)


@query("rep_h10_size", f"""
    SELECT nspname, relname, table_bytes AS bytes, {pretty("table_bytes")} AS size FROM {USER_RELATIONS} ORDER BY 3 DESC, 2 LIMIT 20""")
def _(t):
    return H.largest_relations(t.pg_class, t.pg_namespace)


@query("rep_h11", """
    SELECT inst_id, sum(CASE WHEN temp_space_allocated > 0 THEN 1 ELSE 0 END)::BIGINT AS temp_files,
           sum(temp_space_allocated)::BIGINT AS temp_bytes FROM $activity_samples GROUP BY 1""")
def _(t):
    return H.temp_files(t.activity_samples)


@query("rep_h12", """
    SELECT relname, CASE WHEN seq_scan + idx_scan <> 0 THEN 100.0::DOUBLE * idx_scan / (seq_scan + idx_scan) ELSE 0 END AS pct_index_used,
           n_live_tup AS rows_in_table FROM $pg_user_tables""")
def _(t):
    return H.index_use(t.pg_user_tables)


@query("rep_h13", rf"""
    SELECT nspname, relname, table_bytes + index_bytes AS total_bytes, {pretty("(table_bytes + index_bytes)")} AS total_size
    FROM {USER_RELATIONS} AND nspname NOT LIKE 'pg_toast%' AND nspname NOT LIKE '\_edb%' ESCAPE '\'
      AND relname IN (SELECT relname FROM $pg_user_tables WHERE n_live_tup > 15) ORDER BY 3 DESC, 2 LIMIT 25""")
def _(t):
    keyed = t.pg_user_tables.filter("n_live_tup > 15").select("relname")
    return H.largest_keyed_tables(t.pg_class, t.pg_namespace, keyed)


@query("rep_h14", """
    WITH columns AS (
        SELECT schemaname, tablename, CAST(sum((100 - null_pct) * avg_width) AS BIGINT) / 100.0::DOUBLE + 24 AS bare_row,
               max(null_pct) / 100.0::DOUBLE AS null_share, 24 + sum(CASE WHEN null_pct <> 0 THEN 1 ELSE 0 END)::BIGINT // 8 AS map_bytes
        FROM $pg_stats GROUP BY 1, 2),
    needed AS (
        SELECT k.schemaname, k.tablename, c.relpages AS has,
               ceil(c.reltuples * (4 * ceil(bare_row / 4) + null_share * 4 * ceil(map_bytes / 4.0::DOUBLE) + 4) / 8172.0::DOUBLE) AS needs,
               coalesce(x.relname, '?') AS iname, coalesce(x.relpages, 0) AS index_has,
               coalesce(ceil(x.reltuples * (bare_row - 12) / 8172.0::DOUBLE), 0) AS index_needs
        FROM columns k JOIN $pg_class c ON c.relname = k.tablename JOIN $pg_namespace n ON n.oid = c.relnamespace AND n.nspname = k.schemaname
             AND n.nspname <> 'information_schema'
        LEFT JOIN $pg_index i ON i.indrelid = c.oid LEFT JOIN $pg_class x ON x.oid = i.indexrelid)
    SELECT schemaname, tablename, coalesce(round(has / nullif(needs, 0), 1), 0) AS tbloat,
           CAST(round(greatest(0, 8192 * (has - needs) / 1024 / 1024), 0) AS BIGINT) AS wasted_mb, iname,
           coalesce(round(index_has / nullif(index_needs, 0), 1), 0) AS ibloat,
           greatest(0, 8192 * (index_has - index_needs) / 1024 / 1024) AS wasted_index_mb
    FROM needed ORDER BY wasted_mb DESC, tablename, iname LIMIT 25""")
def _(t):
    stats = t.pg_stats.withColumn("null_frac", (F.col("null_pct") / 100).cast("decimal(10,2)"))
    return H.bloat(stats, t.pg_class, t.pg_namespace, t.pg_index)


@query("rep_h15", """
    SELECT relname, n_tup_ins, n_tup_upd, n_tup_del, n_live_tup, n_dead_tup FROM $pg_user_tables ORDER BY n_dead_tup DESC, relname LIMIT 10""")
def _(t):
    return H.dead_rows(t.pg_user_tables, ["relname", "n_tup_ins", "n_tup_upd", "n_tup_del", "n_live_tup", "n_dead_tup"], 10)


def long_check(list_name: str, seconds: int, state: str | None) -> str:
    extra = f"AND state = '{state}' AND query NOT LIKE 'autovacuum%'" if state else ""
    return f"""
        SELECT '{list_name}' AS list, pid, usename, client_addr, {age("query_start")} AS duration, query, state FROM $pg_activity
        WHERE query_start < TIMESTAMP '{NOW}' - INTERVAL {seconds} SECOND {extra}"""


LONG = (("active", 300, "active"), ("idle", 300, "idle"), ("idle in transaction", 300, "idle in transaction"), ("any", 600, None))


@query("rep_h16", " UNION ALL ".join(long_check(*case) for case in LONG))
def _(t):
    lists = [
        H.long_sessions(t.pg_activity, as_ntz(NOW), seconds, state).withColumn("list", F.lit(name))
        for name, seconds, state in LONG
    ]
    out = lists[0]
    for rows in lists[1:]:
        out = out.unionByName(rows)
    return out
