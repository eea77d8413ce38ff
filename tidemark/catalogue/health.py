"""The database health reports on derived telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalogue.counters import HMS_OF, TREE, hms
from tidemark.catalogue.generic import HOURS
from tidemark.catalogue.registry import query
from tidemark.operators.aggregates import hourly_volume
from tidemark.operators.counters import gap_extremes
from tidemark.operators.filters import as_ntz
from tidemark.plans import health as R

NOW = "2024-01-20 12:00:00"
IDLE = ", ".join(f"'{event}'" for event in R.IDLE_EVENTS)


@query("rep_r01", """
    SELECT name, unq_name, strftime(startup_time, '%d-%m-%y %H:%M:%S') AS starttime, open_mode, instance_role, log_mode,
           CAST(scn AS VARCHAR) AS scn, database_role, flashback_on, version, logins FROM $databases JOIN $db_instances ON name = upper(instance_name)""")
def _(t):
    return R.identity(t.databases, t.db_instances)


@query("rep_r02", """
    WITH rac AS (SELECT count(*) || '-node cluster' AS v FROM $db_instances),
    m AS (SELECT sum(CASE WHEN name = 'memory_target' THEN value END) AS mem, sum(CASE WHEN name = 'sga_target' THEN value END) AS sga,
                 sum(CASE WHEN name = 'pga_aggregate_target' THEN value END) AS pga FROM $parameters),
    o AS (SELECT sum(CASE WHEN stat_name = 'NUM_CPU_CORES' THEN value END) AS cores, sum(CASE WHEN stat_name = 'NUM_CPUS' THEN value END) AS cpus,
                 sum(CASE WHEN stat_name = 'PHYSICAL_MEMORY_BYTES' THEN value END) AS ram FROM $osstat)
    SELECT 'Database name:' AS item, name AS value FROM $databases
    UNION ALL SELECT DISTINCT 'Database version:', version FROM $db_instances
    UNION ALL SELECT 'Database block size:', max(value) // 1024 || ' KB' FROM $parameters WHERE name = 'db_block_size'
    UNION ALL SELECT 'Database size:', printf('%.3f TB', round(((SELECT sum(bytes) FROM $data_files) + (SELECT sum(bytes) FROM $temp_files)
        + (SELECT sum(bytes) * max(members) FROM $log_groups) + (SELECT sum(block_size * blocks) FROM $control_files)) / 1e12, 3))
    UNION ALL SELECT 'Hardware:', 'Engineered System with ' || count(DISTINCT cell_name) || ' storage servers' FROM $cells
    UNION ALL SELECT 'Processor:', 'x86-64'
    UNION ALL SELECT 'Datafiles:', count(*) || ' (on ' || count(DISTINCT tablespace_name) || ' tablespaces)' FROM $data_files
    UNION ALL SELECT 'Database configuration:', v FROM rac
    UNION ALL SELECT 'Database memory:', printf('MEMORY %.1f GB, ', round(mem / 1073741824.0::DOUBLE, 1)) || printf('SGA %.1f GB, ', round(sga / 1073741824.0::DOUBLE, 1))
              || printf('PGA %.1f GB, ', round(pga / 1073741824.0::DOUBLE, 1)) || 'AMM' FROM m
    UNION ALL SELECT 'Physical CPUs:', cores || ' cores, on ' || v FROM o, rac
    UNION ALL SELECT 'CPUs:', cpus || ' CPUs (threads), on ' || v FROM o, rac
    UNION ALL SELECT 'Physical RAM:', printf('%.1f GB', round(ram / 1073741824.0::DOUBLE, 1)) || ', on ' || v FROM o, rac
    UNION ALL SELECT 'Operating system:', max(platform_name) FROM $databases""")
def _(t):
    return R.configuration_summary(t.databases, t.db_instances, t.parameters, t.data_files, t.temp_files, t.log_groups, t.control_files, t.osstat, t.cells, "x86-64")


@query("rep_r03", "SELECT comp_id, comp_name, status, version FROM $components_registry")
def _(t):
    return t.components_registry.select("comp_id", "comp_name", "status", "version")


@query("rep_r04", """
    SELECT strftime(action_time, '%Y-%m-%d %H:%M:%S') AS action_time, action, namespace, id, comments FROM $registry_history""")
def _(t):
    history = t.registry_history.orderBy("action_time", "id")
    return history.withColumn("action_time", F.date_format("action_time", "yyyy-MM-dd HH:mm:ss"))


@query("rep_r05", """
    WITH s AS (SELECT thread_no, max(CASE WHEN dest_id = 1 AND archived = 'YES' THEN sequence_no END) AS a,
                      max(CASE WHEN dest_id = 2 AND applied = 'YES' THEN sequence_no END) AS p,
                      max(CASE WHEN dest_id = 2 AND applied = 'YES' THEN completion_time END) AS applied_time
               FROM $archived_log GROUP BY 1)
    SELECT thread_no, db_name, applied_time, a - p AS log_gap,
           CASE WHEN a - p > 5 OR (applied_time IS NULL) <> (a - p IS NULL) THEN 'Error! Log Gap is ' ELSE 'OK!' END AS status
    FROM s JOIN (SELECT inst_id, min(instance_name) AS db_name FROM $db_instances GROUP BY 1) i ON inst_id = thread_no""")
def _(t):
    return R.standby_gap(t.archived_log, t.db_instances)


@query("rep_r06", """
    SELECT j.session_recid, j.session_stamp, start_time, end_time, output_bytes / 1048576.0::DOUBLE AS output_mbytes, status,
           input_type, dayname(start_time) AS dow, elapsed_seconds, cf, df, i0, i1, l, output_instance
    FROM $backup_jobs j LEFT JOIN (
        SELECT session_recid, session_stamp, sum(CASE WHEN controlfile_included = 'YES' THEN pieces ELSE 0 END)::BIGINT AS cf,
               sum(CASE WHEN controlfile_included = 'NO' AND k = 'D' THEN pieces ELSE 0 END)::BIGINT AS df,
               sum(CASE WHEN k = 'D0' THEN pieces ELSE 0 END)::BIGINT AS i0, sum(CASE WHEN k = 'I1' THEN pieces ELSE 0 END)::BIGINT AS i1,
               sum(CASE WHEN backup_type = 'L' THEN pieces ELSE 0 END)::BIGINT AS l
        FROM (SELECT *, backup_type || coalesce(CAST(incremental_level AS VARCHAR), '') AS k FROM $backup_sets) b
        WHERE input_file_scan_only = 'NO' GROUP BY 1, 2) x USING (session_recid, session_stamp)
    LEFT JOIN (SELECT session_recid, session_stamp, min(inst_id) AS output_instance FROM $backup_sets GROUP BY 1, 2) o
        USING (session_recid, session_stamp)
    WHERE start_time > TIMESTAMP '2001-07-20 00:00:00' - INTERVAL 8 DAY""")
def _(t):
    return R.backup_jobs(t.backup_jobs, t.backup_sets, as_ntz("2001-07-20 10:00:00"))


@query("rep_r07", """
    SELECT name, space_limit / 1073741824.0::DOUBLE AS space_limit_gb,
           (space_limit - space_used + space_reclaimable) / 1073741824.0::DOUBLE AS space_available_gb,
           round((space_used - space_reclaimable) / space_limit * 100, 1) AS percent_full FROM $recovery_area""")
def _(t):
    return R.recovery_area(t.recovery_area)


@query("rep_r08", """
    WITH s AS (
        SELECT d.tablespace_name, bytes, free FROM (SELECT tablespace_name, sum(bytes) AS bytes FROM $data_files GROUP BY 1) d
        LEFT JOIN (SELECT tablespace_name, sum(bytes) AS free FROM $free_space GROUP BY 1) f ON f.tablespace_name = d.tablespace_name
        UNION ALL
        SELECT d.tablespace_name, bytes, free FROM (SELECT tablespace_name, sum(bytes) AS bytes FROM $temp_files GROUP BY 1) d
        LEFT JOIN (SELECT tablespace_name, sum(bytes_free) AS free FROM $temp_header GROUP BY 1) f ON f.tablespace_name = d.tablespace_name)
    SELECT tablespace_name, bytes / 1048576.0::DOUBLE AS size_mb, free / 1048576.0::DOUBLE AS free_mb,
           coalesce(round(free * 100 / bytes::DOUBLE, 0), 1) AS pct_free, round((bytes - free) * 100 / bytes::DOUBLE, 0) AS pct_used FROM s""")
def _(t):
    return R.tablespace_usage(t.data_files, t.free_space, t.temp_files, t.temp_header)


@query("rep_r09", """
    SELECT group_name, CAST(grouping(group_name) AS INT) AS total_level, sum(total_mb)::BIGINT AS total_mb,
           sum(total_mb - free_mb)::BIGINT AS used_mb,
           round(sum(total_mb - free_mb)::DOUBLE / sum(total_mb) * 100, 2) AS pct_used FROM $disk_groups GROUP BY ROLLUP (group_name)""")
def _(t):
    return R.disk_group_usage(t.disk_groups)


@query("rep_r10", """
    SELECT component_no, component, current_size / 1048576.0::DOUBLE AS current_mb, min_size / 1048576.0::DOUBLE AS min_mb,
           last_oper_type AS type FROM $memory_components""")
def _(t):
    return R.memory_components(t.memory_components)


@query("rep_r11", """
    SELECT round(sum(CASE WHEN name <> 'free memory' THEN bytes END) / 1073741824.0::DOUBLE, 2) AS sga_used_gb,
           round(sum(CASE WHEN name = 'free memory' THEN bytes END) / 1073741824.0::DOUBLE, 2) AS sga_free_gb,
           round(sum(bytes) / 1073741824.0::DOUBLE, 2) AS sga_total_gb FROM $sgastat""")
def _(t):
    return R.memory_usage(t.sgastat)


@query("rep_r12", "SELECT * FROM $running_jobs WHERE sid IS NOT NULL")
def _(t):
    return R.running_jobs(t.running_jobs)


@query("rep_r13", "SELECT owner AS occupant, sum(bytes) / 1048576.0::DOUBLE AS mb FROM $segments GROUP BY 1")
def _(t):
    return R.occupants(t.segments)


@query("rep_r14", """
    SELECT sid, serial_no, target, opname, totalwork, sofar, elapsed_seconds / 60.0::DOUBLE AS elapsed_min, time_remaining
    FROM $long_ops WHERE totalwork <> sofar""")
def _(t):
    return R.long_operations(t.long_ops)


def in_flight_check(extra: str) -> str:
    return f"""
        SELECT s.inst_id, sid, serial_no, username, s.sql_id, plan_hash_value, disk_reads, buffer_gets, rows_processed, event,
               osuser, program, module, machine, seconds_in_wait, state, sql_text,
               strftime(logon_time, '%m-%d-%Y %H:%M:%S') AS logontime, {hms("last_call_et")} AS running_since
        FROM $sessions s JOIN $sqlarea a ON a.inst_id = s.inst_id AND a.address = s.sql_address AND a.hash_value = s.sql_hash_value
        WHERE status = 'ACTIVE' AND username IS NOT NULL {extra}"""


@query("rep_r15", in_flight_check(""))
def _(t):
    return R.in_flight(t.sessions, t.sqlarea)


@query("rep_r16", """
    SELECT max(sequence_no) AS last_sequence, max(completion_time) AS completion_time, max(block_size) AS block_size FROM $archived_log""")
def _(t):
    return t.archived_log.agg(
        F.max("sequence_no").alias("last_sequence"), F.max("completion_time").alias("completion_time"),
        F.max("block_size").alias("block_size"),
    )


@query("rep_r16_files", "SELECT group_no, member, type, sequence_no FROM $log_files")
def _(t):
    return t.log_files.orderBy("group_no", "sequence_no")


@query("rep_r17", f"""
    SELECT thread_no, strftime(first_time, '%Y-%m-%d') AS log_date, {HOURS}, count(*) AS total FROM $archived_log GROUP BY 1, 2""")
def _(t):
    return hourly_volume(t.archived_log, ["thread_no"], "first_time").orderBy("log_date", "thread_no")


@query("rep_r18", HMS_OF)
def _(t):
    return gap_extremes(t.archived_log, "first_time", "completion_time", "sequence_no")


@query("rep_r19", "SELECT * FROM $resource_limits WHERE resource_name IN ('sessions', 'processes')")
def _(t):
    return t.resource_limits.filter(F.col("resource_name").isin("sessions", "processes"))


JOINED = "$sessions s JOIN $processes p ON p.addr = s.paddr AND p.inst_id = s.inst_id"


@query("rep_r20", f"""
    SELECT sum(CASE WHEN status = 'INACTIVE' THEN 1 ELSE 0 END)::BIGINT AS inactive_sessions,
           sum(CASE WHEN status = 'INACTIVE' AND last_call_et > 10800 THEN 1 ELSE 0 END)::BIGINT AS long_inactive_sessions,
           sum(CASE WHEN status = 'ACTIVE' THEN 1 ELSE 0 END)::BIGINT AS active_sessions FROM {JOINED}""")
def _(t):
    return R.session_counts(t.sessions, t.processes)


@query("rep_r21", f"""
    SELECT program, count(*) AS inactive_sessions FROM {JOINED} WHERE status = 'INACTIVE' AND last_call_et > 1000 GROUP BY 1""")
def _(t):
    return R.inactive_by_program(t.sessions, t.processes, 1000)


@query("rep_r22", f"""
    SELECT spid, sid, serial_no, last_call_et / 3600.0::DOUBLE AS last_call_hours, status, module, program, disk_reads,
           CASE WHEN length(sql_text) > 30 THEN substring(sql_text, 1, 30) ELSE lpad(sql_text, 30, ' ') END AS last_sql
    FROM {JOINED} JOIN $sqlarea a ON a.inst_id = s.inst_id AND a.address = s.sql_address AND a.hash_value = s.sql_hash_value
    WHERE status = 'INACTIVE' AND last_call_et > 1000""")
def _(t):
    return R.inactive_detail(t.sessions, t.processes, t.sqlarea, 1000, width=30)


EXCLUDED_OWNERS = ["Brand#1", "Brand#2", "SYS", "SYSTEM"]
NOT_OWNERS = ", ".join(f"'{o}'" for o in EXCLUDED_OWNERS)


@query("rep_r23", f"""
    SELECT * FROM (SELECT *, round((last_number - min_value) * 100.0::DOUBLE / greatest(max_value - min_value, 1), 1) AS percent_used
                   FROM $sequences WHERE sequence_owner NOT IN ({NOT_OWNERS}) AND max_value > 0) s WHERE percent_used > 90""")
def _(t):
    return R.sequence_exhaustion(t.sequences, EXCLUDED_OWNERS)


@query("rep_r24", f"""
    SELECT strftime(originating_timestamp, '%d.%m.%Y %H:%M:%S') AS message_time, inst_id, message_text, host_id, adr_home
    FROM $alert_log WHERE originating_timestamp > TIMESTAMP '{NOW}' - INTERVAL 1 DAY
      AND originating_timestamp <= TIMESTAMP '{NOW}' AND component_id = 'rdbms'
      AND message_text LIKE '%ORA-%'""")
def _(t):
    return R.alert_errors(t.alert_log, as_ntz(NOW))


@query("rep_r25", "SELECT event, state, inst_id, count(*) AS n FROM $sessions GROUP BY 1, 2, 3")
def _(t):
    return R.current_waits(t.sessions)


@query("rep_r26", f"""
    SELECT inst_id, event, time_waited_micro, total_waits, total_timeouts FROM $system_event WHERE event NOT IN ({IDLE})
    ORDER BY time_waited_micro DESC, event, inst_id LIMIT 10""")
def _(t):
    return R.top_events(t.system_event)


@query("rep_r27", """
    SELECT *, round(value, 2) AS w_metric_value FROM $sysmetric WHERE group_id = 2
      AND metric_name IN ('Executions Per Sec', 'Logons Per Sec', 'Host CPU Usage Per Sec')""")
def _(t):
    return R.load_profile(t.sysmetric)


@query("rep_r28", """
    SELECT s.inst_id, username, sid, serial_no, used_ublk, used_urec, segment_name, rssize, r.status FROM $transactions x
    JOIN $sessions s ON s.saddr = x.ses_addr AND s.inst_id = x.inst_id JOIN $rollback_segments r ON r.usn = x.xidusn""")
def _(t):
    return R.undo_usage(t.transactions, t.sessions, t.rollback_segments)


@query("rep_r29", """
    SELECT u.username, sid, spid, u.sql_id, sql_text, u.tablespace, blocks * block_size / 1048576.0::DOUBLE AS usage_mb FROM (
        SELECT inst_id, username, sql_id, tablespace, session_addr, sum(blocks)::BIGINT AS blocks FROM $sort_usage
        GROUP BY 1, 2, 3, 4, 5 HAVING sum(blocks) > 1000) u
    JOIN $sessions s ON s.saddr = u.session_addr AND s.inst_id = u.inst_id
    JOIN $processes p ON p.addr = s.paddr AND p.inst_id = s.inst_id JOIN $sqlarea a ON a.sql_id = u.sql_id
    JOIN $tablespaces d ON d.tablespace_name = u.tablespace""")
def _(t):
    return R.temp_usage(t.sort_usage, t.sqlarea, t.sessions, t.processes, t.tablespaces)


@query("rep_r30", f"""
    SELECT sql_id, max(temp_space_allocated) / 1073741824.0::DOUBLE AS gig FROM $activity_samples
    WHERE sample_time > TIMESTAMP '{NOW}' - INTERVAL 2 HOUR AND sample_time <= TIMESTAMP '{NOW}' AND temp_space_allocated > 5368709120 GROUP BY 1""")
def _(t):
    return R.temp_by_statement(t.activity_samples, as_ntz(NOW))


@query("rep_r31", f"""
    SELECT s.inst_id, s.sql_id, sid, state, event, seconds_in_wait AS seconds, p1, sql_text AS last_sql FROM $sessions s
    JOIN $sqlarea a ON a.inst_id = s.inst_id AND a.address = s.sql_address
    WHERE event NOT IN ({IDLE}) AND seconds_in_wait > 0""")
def _(t):
    return R.waiting_sessions(t.sessions, t.sqlarea)


@query("rep_r32", f"""
    SELECT h.sql_id, c_name AS username, sql_text, sum(wait_time + time_waited)::BIGINT AS ttl_wait_time
    FROM $activity_samples h JOIN $sqlarea a ON a.sql_id = h.sql_id JOIN $customer ON c_custkey = h.user_id
    WHERE sample_time BETWEEN TIMESTAMP '{NOW}' - INTERVAL 1 HOUR AND TIMESTAMP '{NOW}'
    GROUP BY 1, 2, 3 ORDER BY 4 DESC, 1, 2 LIMIT 5""")
def _(t):
    users = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"))
    return R.top_waiting_sql(t.activity_samples, t.sqlarea, users, as_ntz(NOW))


def top_sql_check(shown: str, measure: str, least: str, per_execution: bool = True) -> str:
    order = f"{shown}_per_exec" if per_execution else shown
    ratio = f", {shown}::DOUBLE / CASE executions WHEN 0 THEN 1 ELSE executions END AS {order}" if per_execution else ""
    base = ["inst_id", "sql_id", "hash_value", "sql_text", "executions", "buffer_gets", "disk_reads"]
    columns = ", ".join(dict.fromkeys(base + [shown, order]))
    return f"""
        SELECT {columns}, CAST(row_number() OVER (ORDER BY {order} DESC, sql_id, inst_id) AS INT) AS rank FROM (
            SELECT * {ratio} FROM (SELECT * REPLACE ({measure} AS {shown}) FROM $sqlarea) m WHERE {shown} > {least}) x
        ORDER BY rank LIMIT 10"""


ELAPSED = top_sql_check("elapsed_time", "elapsed_time / 1000000.0::DOUBLE", "5")


def top_elapsed(t):
    """Statements with the longest run time per execution: the flagship report."""
    return R.top_sql(t.sqlarea, F.col("elapsed_time") / 1e6, "elapsed_time", 5)


@query("rep_r33", ELAPSED)
def _(t):
    return top_elapsed(t)


@query("topn_safe_ratio", ELAPSED)
def _(t):
    return top_elapsed(t)


@query("rep_r34", top_sql_check("disk_reads", "disk_reads", "10000"))
def _(t):
    return R.top_sql(t.sqlarea, F.col("disk_reads"), "disk_reads", 10000)


@query("rep_r35", top_sql_check("buffer_gets", "buffer_gets", "50000"))
def _(t):
    return R.top_sql(t.sqlarea, F.col("buffer_gets"), "buffer_gets", 50000)


@query("rep_r36", """
    SELECT sql_id, inst_id, substring(sql_text, 1, 80) AS sql_text, concurrency_wait_time / 1000.0::DOUBLE AS con_time_ms,
           con_time_pct, pct_of_con_time, CAST(rank AS INT) AS rank FROM (
        SELECT *, round(concurrency_wait_time * 100 / elapsed_time, 2) AS con_time_pct,
               round(concurrency_wait_time::DOUBLE * 100 / sum(concurrency_wait_time) OVER (), 2) AS pct_of_con_time,
               rank() OVER (ORDER BY concurrency_wait_time DESC) AS rank FROM $sqlarea WHERE elapsed_time > 0) c WHERE rank <= 10""")
def _(t):
    return R.concurrency_sql(t.sqlarea, width=80)


@query("rep_r37", f"""
    SELECT spid, s.sid, serial_no, s.inst_id, sql_id, username, program, machine, value / 100.0::DOUBLE AS cpu_usage_seconds
    FROM {JOINED} JOIN $sesstat e ON e.sid = s.sid AND e.inst_id = s.inst_id JOIN $statname n ON n.statistic_no = e.statistic_no
    WHERE n.name LIKE '%CPU used by this session%' AND status = 'ACTIVE' AND username IS NOT NULL AND username <> 'SYS' AND value > 0
    ORDER BY value DESC, s.sid LIMIT 15""")
def _(t):
    return R.cpu_sessions(t.sesstat, t.statname, t.sessions, t.processes)


CPU = "cpu_time / 1000000.0::DOUBLE"


@query("rep_r38", top_sql_check("cpu_time", CPU, "5", False))
def _(t):
    return R.top_sql(t.sqlarea, F.col("cpu_time") / 1e6, "cpu_time", 5, per_execution=False)


@query("rep_r39", top_sql_check("cpu_time", CPU, "5"))
def _(t):
    return R.top_sql(t.sqlarea, F.col("cpu_time") / 1e6, "cpu_time", 5)


@query("rep_r40", """
    SELECT wait_type, sum(total_waits)::BIGINT AS total_waits, round(sum(micro) / 1000000.0::DOUBLE, 2) AS time_waited_seconds,
           round(sum(micro)::DOUBLE * 100 / sum(sum(micro)) OVER (), 2) AS pct FROM (
        SELECT CASE WHEN event LIKE 'direct path% temp' THEN 'direct path read / write temp'
                    WHEN event LIKE 'direct path%' THEN 'direct path read / write non-temp'
                    WHEN wait_class = 'User I/O' THEN event ELSE wait_class END AS wait_type, total_waits, time_waited_micro AS micro
        FROM $system_event
        UNION ALL SELECT 'CPU', NULL, value FROM $sys_time_model WHERE stat_name IN ('background cpu time', 'DB CPU')) l
    WHERE wait_type <> 'Idle' GROUP BY 1""")
def _(t):
    return R.wait_breakdown(t.system_event, t.sys_time_model)


@query("rep_r41", in_flight_check("AND event LIKE '%TM - contention%'"))
def _(t):
    return R.in_flight(t.sessions, t.sqlarea, "%TM - contention%")


@query("rep_r42", in_flight_check("AND event LIKE '%row lock contention%'"))
def _(t):
    return R.in_flight(t.sessions, t.sqlarea, "%row lock contention%")


@query("rep_r43", TREE.replace("WHERE blocking_session IS NOT NULL", "WHERE blocking_session IS NOT NULL AND username IS NOT NULL"))
def _(t):
    return R.lock_tree(t.sessions)


@query("rep_r44", """
    SELECT lock_no, CASE is_blocking WHEN 0 THEN 'Waiting' ELSE 'Blocking ->' END AS user_status,
           '''' || l.sid || ',' || serial_no || '''' AS sid_serial, l.inst_id, program, osuser, machine,
           CASE lock_type WHEN 'TM' THEN 'DML' ELSE 'Transaction' END AS lock_type,
           CASE lmode WHEN 0 THEN 'None' WHEN 3 THEN 'Row Excl.' ELSE 'Exclusive' END AS lock_mode, ctime, object_name, id1, id2
    FROM $locks l JOIN $sessions s ON s.inst_id = l.inst_id AND s.sid = l.sid
    JOIN $locked_objects o ON o.inst_id = s.inst_id AND o.session_id = s.sid JOIN $objects d ON d.object_id = o.object_id
    WHERE (id1, id2, lock_type) IN (SELECT (id1, id2, lock_type) FROM $locks WHERE request > 0)""")
def _(t):
    return R.lock_detail(t.locks, t.sessions, t.locked_objects, t.objects)


BLOCKED = """
    WITH h AS (SELECT lock_type, id1, id2, inst_id, sid, max(ctime) AS ctime FROM $cluster_locks WHERE is_blocking = 1 GROUP BY ALL),
    w AS (SELECT DISTINCT lock_type, id1, id2, inst_id, sid FROM $cluster_locks WHERE request > 0),
    b AS (SELECT lock_type, id1, id2, waiter_inst_id, waiter_sid, blocker_inst_id, blocker_sid, n_blockers FROM (
        SELECT w.lock_type, w.id1, w.id2, w.inst_id AS waiter_inst_id, w.sid AS waiter_sid, h.inst_id AS blocker_inst_id,
               h.sid AS blocker_sid, count(*) OVER p AS n_blockers, row_number() OVER (p ORDER BY h.ctime DESC, h.inst_id, h.sid) AS place
        FROM w JOIN h ON h.lock_type = w.lock_type AND h.id1 = w.id1 AND h.id2 = w.id2 AND (h.inst_id, h.sid) <> (w.inst_id, w.sid)
        WINDOW p AS (PARTITION BY w.lock_type, w.id1, w.id2, w.inst_id, w.sid)) x WHERE place = 1)"""


@query("rep_r45", BLOCKED + " SELECT * FROM b")
def _(t):
    return R.who_blocks_whom(t.cluster_locks)


@query("rep_r46", BLOCKED + """
    SELECT lock_type, id1, id2, n_blockers, concat_ws('@', x.username, x.machine) || ' ( SID=' || blocker_sid || ' )  is blocking ' ||
           concat_ws('@', y.username, y.machine) || ' ( SID=' || waiter_sid || ' ) ' AS blocking_status
    FROM b JOIN $cluster_sessions x ON x.sid = blocker_sid AND x.inst_id = blocker_inst_id
    JOIN $cluster_sessions y ON y.sid = waiter_sid AND y.inst_id = waiter_inst_id""")
def _(t):
    return R.who_blocks_whom_text(t.cluster_locks, t.cluster_sessions)


@query("rep_r47", """
    SELECT lock_no, sid, lock_type, CASE is_blocking WHEN 0 THEN 'NO' ELSE 'YES' END AS blocker,
           CASE request WHEN 0 THEN 'NO' ELSE 'YES' END AS waiter, CASE lmode WHEN 3 THEN 'RX' WHEN 6 THEN 'X' ELSE 'NONE' END AS held,
           CASE request WHEN 6 THEN 'X' ELSE 'NONE' END AS asked, ctime // 60 AS minutes, id1, id2
    FROM $locks WHERE request > 0 OR is_blocking = 1""")
def _(t):
    return R.lock_list(t.locks)


@query("rep_r48", f"""
    SELECT object_name, object_type, event, sum(wait_time + time_waited)::BIGINT AS ttl_wait_time
    FROM $activity_samples JOIN $objects ON object_id = current_obj
    WHERE sample_time BETWEEN TIMESTAMP '{NOW}' - INTERVAL 1 HOUR AND TIMESTAMP '{NOW}'
    GROUP BY 1, 2, 3 ORDER BY 4 DESC, 1, 3 LIMIT 5""")
def _(t):
    return R.top_object_waits(t.activity_samples, t.objects, as_ntz(NOW))


@query("rep_r49", """
    SELECT name, sum(value)::BIGINT AS value FROM $sysstat
    WHERE name LIKE 'gc% lost' OR name LIKE 'gc% received' OR name LIKE 'gc% served' GROUP BY 1""")
def _(t):
    return R.block_transfers(t.sysstat)


@query("rep_r50", """
    SELECT 'Current Process: ' || waiter AS w_proc, 'SID ' || coalesce(i.instance_name, '') AS instance, 'INST #: ' || instance AS inst,
           'Blocking Process: ' || coalesce(CAST(blocker AS VARCHAR), '<none>') || ' from Instance ' || coalesce(CAST(blocker_instance AS VARCHAR), '') AS blocker_proc,
           'Number of waiters: ' || num_waiters AS waiters, 'Wait Event: ' || wait_event_text AS wait_event,
           'P1: ' || p1 AS p1, 'P2: ' || p2 AS p2, 'P3: ' || coalesce(CAST(p3 AS VARCHAR), '') AS p3,
           'Seconds in Wait: ' || in_wait_secs AS seconds, 'Seconds Since Last Wait: ' || since_last_wait_secs AS sincelw,
           'Wait Chain: ' || chain_id || ': ' || chain_signature AS chain_signature,
           'Blocking Wait Chain: ' || coalesce(CAST(blocker_chain_id AS VARCHAR), '<none>') AS blocker_chain FROM (
        SELECT * FROM $wait_chains WHERE num_waiters > 0 OR (blocker IS NOT NULL AND in_wait_secs > 10)
        ORDER BY chain_id, num_waiters DESC, waiter LIMIT 100) w LEFT JOIN $db_instances i ON i.instance_number = w.instance""")
def _(t):
    return R.wait_chain_report(t.wait_chains, t.db_instances)


@query("rep_r51", """
    SELECT * FROM (SELECT inst_id, name AS latch_name, round((gets - misses)::DOUBLE / gets, 3) AS hit_ratio,
                          round(sleeps::DOUBLE / CASE misses WHEN 0 THEN 1 ELSE misses END, 3) AS sleeps_per_miss
                   FROM $latches WHERE gets <> 0) l WHERE hit_ratio < 0.99""")
def _(t):
    return R.latch_hit_ratio(t.latches)


@query("rep_r52", """
    SELECT name, inst_id, gets, misses, round(misses * 100.0::DOUBLE / (gets + 1), 3) AS misses_gets_pct, spin_gets, sleep1, wait_time,
           round(wait_time / 1000000.0::DOUBLE, 0) AS wait_time_seconds, CAST(misses_rank AS INT) AS misses_rank FROM (
        SELECT *, rank() OVER (ORDER BY wait_time DESC) AS misses_rank FROM $latches
        WHERE gets + misses + sleep1 + wait_time > 0) v WHERE misses_rank <= 10""")
def _(t):
    return R.latch_waits(t.latches)


@query("rep_r53", """
    SELECT * FROM (SELECT inst_id, name AS latch_name, round(immediate_gets::DOUBLE / (immediate_gets + immediate_misses), 3) AS hit_ratio,
                          round(sleeps::DOUBLE / CASE immediate_misses WHEN 0 THEN 1 ELSE immediate_misses END, 3) AS sleeps_per_miss
                   FROM $latches WHERE immediate_gets + immediate_misses > 0) l WHERE hit_ratio < 0.99""")
def _(t):
    return R.latch_immediate(t.latches)


@query("rep_r54", """
    SELECT n.sql_id, child_cursors, CAST(sql_rank AS INT) AS sql_rank, sql_text FROM (
        SELECT sql_id, count(*) AS child_cursors, rank() OVER (ORDER BY count(*) DESC NULLS LAST) AS sql_rank
        FROM $shared_cursors GROUP BY 1 HAVING count(*) > 99) n
    LEFT JOIN (SELECT sql_id, min(sql_text) AS sql_text FROM $sqlarea GROUP BY 1) a ON a.sql_id = n.sql_id""")
def _(t):
    return R.unshared_cursors(t.shared_cursors, t.sqlarea)


@query("rep_r55", """
    SELECT inst_id, session_id AS sid, coalesce(username, '(none)') AS username, owner AS object_owner, object_name,
           CASE locked_mode WHEN 0 THEN 'None' WHEN 1 THEN 'Null (NULL)' WHEN 2 THEN 'Row-S (SS)' WHEN 3 THEN 'Row-X (SX)'
                WHEN 4 THEN 'Share (S)' WHEN 5 THEN 'S/Row-X (SSX)' WHEN 6 THEN 'Exclusive (X)'
                ELSE CAST(locked_mode AS VARCHAR) END AS locked_mode, os_user_name
    FROM $locked_objects b JOIN $objects a ON a.object_id = b.object_id""")
def _(t):
    return R.locked_objects(t.objects, t.locked_objects)


@query("rep_r56", """
    SELECT owner || '.' || object_name AS oname, object_type AS otyp, subobject_name AS sname, event, cnt, twait, sql_id, module FROM (
        SELECT current_obj, sql_id, module, event, count(*) AS cnt, sum(time_waited + wait_time)::BIGINT AS twait FROM $activity_samples
        WHERE event <> 'pmon timer' AND event NOT LIKE 'SQL*Net%' AND event NOT LIKE 'Backup%' GROUP BY 1, 2, 3, 4) h
    JOIN $objects ON object_id = current_obj ORDER BY twait DESC, oname, sql_id, event, module NULLS FIRST LIMIT 30""")
def _(t):
    return R.object_waits(t.activity_samples, t.objects)


@query("rep_r57", "SELECT name, created, status, sql_text FROM $sql_profiles")
def _(t):
    return R.sql_profiles(t.sql_profiles)


@query("rep_r58", f"""
    SELECT strftime(sample_time, '%H:%M:%S') AS hhmmss, coalesce(CAST(qc_session_id AS VARCHAR), 'n/a') AS qc, inst_id, session_id AS sid,
           pga_allocated / 1024.0::DOUBLE AS kb, sql_id, coalesce(module, '<' || program || '>') AS module
    FROM $activity_samples WHERE pga_allocated > 2097152 AND sample_time > TIMESTAMP '{NOW}' - INTERVAL 3600 SECOND
      AND sample_time <= TIMESTAMP '{NOW}'""")
def _(t):
    return R.private_memory(t.activity_samples, as_ntz(NOW), 3600)


@query("rep_r59", """
    SELECT owner, segment_name, segment_type, tablespace_name, round(sum(bytes) / 1073741824.0::DOUBLE, 0) AS size_in_gb,
           sum(bytes)::BIGINT AS bytes FROM $segments GROUP BY 1, 2, 3, 4 ORDER BY sum(bytes) DESC, 1, 2, 3, 4 LIMIT 10""")
def _(t):
    return R.top_segments(t.segments)


@query("rep_r60", """
    SELECT x.table_owner, x.table_name, round(tb / 1e6, 0) / 1000 AS table_gb, x.owner AS index_owner, x.index_name, round(ib / 1e6, 0) / 1000 AS index_gb,
           round((ib - tb) / 1e6, 0) / 1000 AS dif_gb, round((ib - tb) * 100.0::DOUBLE / tb, 1) AS dif_perc
    FROM (SELECT owner, segment_name, sum(bytes)::BIGINT AS tb FROM $segments WHERE segment_type LIKE 'TABLE%' GROUP BY 1, 2) t
    JOIN $indexes x ON x.table_owner = t.owner AND x.table_name = t.segment_name
    JOIN (SELECT owner, segment_name, sum(bytes)::BIGINT AS ib FROM $segments WHERE segment_type LIKE 'INDEX%' GROUP BY 1, 2) i
      ON i.owner = x.owner AND i.segment_name = x.index_name
    WHERE ib > tb AND tb > 10000000""")
def _(t):
    return R.indexes_over_tables(t.segments, t.indexes)


@query("rep_r61", rf"""
    SELECT owner, table_name, num_rows, stattype_locked FROM $tab_statistics
    WHERE object_type = 'TABLE' AND stale_stats = 'YES' AND owner NOT IN ({NOT_OWNERS}) AND table_name NOT LIKE 'BIN%'
      AND NOT (table_name LIKE '%TEMP' OR table_name LIKE '%\_TEMP\_%' ESCAPE '\') AND temporary = 'N' AND NOT is_external""")
def _(t):
    tables = t.tab_statistics
    external = tables.filter("is_external").select("owner", "table_name")
    return R.stale_statistics(tables, tables, external, EXCLUDED_OWNERS)


@query("rep_r62", "SELECT * FROM $objects WHERE status = 'INVALID'")
def _(t):
    return R.invalid_objects(t.objects)
