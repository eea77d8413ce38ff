"""The fleet scorecard on derived telemetry."""

from __future__ import annotations

from tidemark.catalogue.generic import MEAN
from tidemark.catalogue.registry import query
from tidemark.plans import fleet

DAY = "2024-01-20 12:00:00"


@query("rep_fleet_scorecard", f"""
    WITH t AS (SELECT target_name, split_part(machine_name, '.', 1) AS host FROM $fleet_targets),
    m AS (SELECT *, split_part(entity_name, '.', 1) AS host FROM $fleet_metrics WHERE date_trunc('day', collection_time) = TIMESTAMP '2024-01-20'),
    cpu AS (SELECT host, round(max(value), 1) AS hi, {MEAN} AS mean FROM m
            WHERE metric_column_label = 'CPU Utilization (%)' GROUP BY 1),
    swap AS (SELECT host, round(max(value), 1) AS hi, {MEAN} AS mean FROM m
             WHERE metric_column_label = 'Swap Utilization (%)' GROUP BY 1),
    iops AS (SELECT host, round(max(value), 1) AS hi, {MEAN} AS mean FROM m
             WHERE metric_column_label LIKE 'Total Disk I/O%' GROUP BY 1),
    tbs AS (SELECT entity_name, metric_key_value, value FROM (
                SELECT *, row_number() OVER (PARTITION BY entity_name, metric_key_value ORDER BY collection_time DESC) AS rn FROM m
                WHERE metric_column_label = 'Tablespace Space Used (%)') x WHERE rn = 1),
    th AS (SELECT target_name, trim(key_value) AS key_value, CAST(warning_threshold AS DOUBLE) AS w, CAST(critical_threshold AS DOUBLE) AS c
           FROM $fleet_thresholds WHERE trim(warning_threshold) <> '' AND trim(critical_threshold) <> ''),
    lvl AS (SELECT entity_name, max(CASE WHEN round(value, 1) >= coalesce(s.c, d.c) THEN 2 WHEN round(value, 1) >= coalesce(s.w, d.w) THEN 1 ELSE 0 END)
                   AS usage_level FROM tbs LEFT JOIN th s ON s.target_name = entity_name AND s.key_value = metric_key_value
            LEFT JOIN th d ON d.target_name = entity_name AND d.key_value = '' WHERE coalesce(s.w, d.w) IS NOT NULL GROUP BY 1),
    fs AS (SELECT host, metric_key_value AS mount, 100 - value AS used FROM (
               SELECT *, row_number() OVER (PARTITION BY host, metric_key_value ORDER BY collection_time DESC) AS rn FROM m
               WHERE metric_column_label = 'Filesystem Space Available (%)' AND metric_key_value <> '/') x WHERE rn = 1),
    dfs AS (SELECT target_name, round(max(used), 1) AS v FROM $fleet_datafiles JOIN fs ON host = lower(split_part(host_name, '.', 1))
                AND mount = CASE WHEN starts_with(file_name, '/') THEN os_storage_entity ELSE substring(file_name, 1, 3) END GROUP BY 1),
    paths AS (SELECT target_name, split_part(host_name, '.', 1) AS host, replace(regexp_replace(value, '^LOCATION=', '', 'i'), chr(36) || 'ORACLE_SID',
                     split_part(target_name, '_', 1)) AS path FROM $fleet_parameters
              WHERE (name LIKE 'log_archive_dest%' AND name NOT LIKE 'log_archive_dest_state%' OR name = 'db_recovery_file_dest')
                AND upper(value) NOT LIKE 'SERVICE=%' AND upper(value) NOT LIKE '%USE_DB_RECOVERY_FILE_DEST%'),
    afs AS (SELECT target_name, round(used, 1) AS v FROM (
                SELECT target_name, used, row_number() OVER (PARTITION BY target_name ORDER BY length(mount) DESC, mount DESC) AS rn
                FROM paths JOIN fs ON fs.host = paths.host AND (path = mount OR starts_with(path, mount || '/'))) x WHERE rn = 1),
    means AS (SELECT entity_name, metric_column_label, metric_key_value, row_number() OVER (PARTITION BY entity_name, metric_column_label
                     ORDER BY {MEAN} DESC, metric_key_value) AS rn
              FROM m GROUP BY 1, 2, 3),
    waits AS (SELECT e.entity_name, e.metric_key_value || ' (' || c.metric_key_value || ')' AS v FROM means e JOIN means c
              ON c.entity_name = e.entity_name AND e.rn = 1 AND c.rn = 1 AND e.metric_column_label LIKE 'Total Foreground%'
              AND c.metric_column_label LIKE 'Database Time%'),
    lag AS (SELECT target_name, max(CASE WHEN column_label LIKE 'Apply%' THEN CAST(value AS DOUBLE) END) AS a,
                   max(CASE WHEN column_label LIKE 'Transport%' THEN CAST(value AS DOUBLE) END) AS p FROM $fleet_standby GROUP BY 1)
    SELECT t.target_name, t.host, cpu.hi AS cpu_max_pc, cpu.mean AS cpu_avg_pc, swap.hi AS swap_max_pc, swap.mean AS swap_avg_pc,
           iops.hi AS iops_max_pc, iops.mean AS iops_avg_pc, tm.v AS tbs_max_pc, usage_level, dfs.v AS data_fs_max_pc,
           afs.v AS arch_fra_fs_max_pc, lag.a AS apply_lag_sec, lag.p AS transport_lag_sec, waits.v AS top_db_wait
    FROM t JOIN cpu USING (host) JOIN swap USING (host) JOIN iops USING (host)
    LEFT JOIN (SELECT entity_name, round(max(value), 1) AS v FROM tbs GROUP BY 1) tm ON tm.entity_name = t.target_name
    LEFT JOIN lvl ON lvl.entity_name = t.target_name LEFT JOIN dfs ON dfs.target_name = t.target_name
    LEFT JOIN afs ON afs.target_name = t.target_name LEFT JOIN lag ON lag.target_name = t.target_name
    LEFT JOIN waits ON waits.entity_name = t.target_name""")
def _(t):
    return fleet.scorecard(
        t.fleet_targets, t.fleet_metrics, t.fleet_thresholds, t.fleet_datafiles, t.fleet_parameters, t.fleet_standby, DAY
    )
