"""Telemetry-shaped frames derived from the star-schema, event and page tables.

Each shape is one deterministic SELECT in the subset of SQL that Spark and DuckDB read alike, so the very
same rows feed a Spark query and the SQL it is checked against. ``$name`` stands for a base table or another
shape, ``$NTZ`` for the timestamp-without-zone type.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.files import read_table

# Columns of the given tables. Declared, so that no read has to look into files for its schema.
BASE_TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
              "o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

SHAPES = {
    # One row per statement; a statement may have no executions at all.
    "sqlarea": """
        SELECT p_partkey % 3 + 1 AS inst_id,
               'sql' || p_partkey AS sql_id,
               'A' || p_partkey AS address,
               p_partkey AS hash_value,
               p_partkey * 7 AS plan_hash_value,
               p_name AS sql_text,
               CAST(coalesce(executions, 0) AS BIGINT) AS executions,
               CAST(coalesce(elapsed_time, 0) AS BIGINT) AS elapsed_time,
               CAST(coalesce(cpu_time, 0) AS BIGINT) AS cpu_time,
               CAST(coalesce(buffer_gets, 0) AS BIGINT) AS buffer_gets,
               CAST(coalesce(disk_reads, 0) AS BIGINT) AS disk_reads,
               CAST(coalesce(rows_processed, 0) AS BIGINT) AS rows_processed,
               CAST(coalesce(concurrency_wait_time, 0) AS BIGINT) AS concurrency_wait_time
        FROM $part LEFT JOIN (
            SELECT l_partkey,
                   sum(CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN 1 ELSE 0 END) AS executions,
                   sum(CAST(floor(l_extendedprice * 4) AS BIGINT)) AS elapsed_time,
                   sum(CAST(floor(l_quantity) AS BIGINT)) * 8000 AS cpu_time,
                   sum(CAST(floor(l_quantity) AS BIGINT)) * 100 AS buffer_gets,
                   sum(CAST(l_linenumber AS BIGINT)) * 100 AS disk_reads,
                   count(*) AS rows_processed,
                   sum(CAST(floor(l_tax * 100 + 0.5) AS BIGINT)) * 1000 AS concurrency_wait_time
            FROM $lineitem GROUP BY l_partkey) l ON l_partkey = p_partkey""",
    # Every event is one reading of a counter; readings may fall back, as after a restart.
    "counter_readings": """
        SELECT user_id % 4 + 1 AS inst_id, event_type AS name, event_id, ts,
               CAST(floor(value * 100) AS BIGINT) AS reading,
               user_id AS waits
        FROM $events""",
    # Daily values of counters that only grow, but restart on day 16.
    "counter_days": """
        SELECT user_id % 4 + 1 AS inst_id, event_type AS name, CAST(extract(day FROM ts) AS BIGINT) AS snap_id,
               count(*) AS n, sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS amount
        FROM $events GROUP BY user_id % 4 + 1, event_type, CAST(extract(day FROM ts) AS BIGINT)""",
    "counter_snapshots": """
        SELECT inst_id, name, snap_id,
               CAST(sum(n) OVER (PARTITION BY inst_id, name, CASE WHEN snap_id < 16 THEN 0 ELSE 1 END
                                 ORDER BY snap_id) AS BIGINT) AS total_waits,
               CAST(sum(amount) OVER (PARTITION BY inst_id, name, CASE WHEN snap_id < 16 THEN 0 ELSE 1 END
                                 ORDER BY snap_id) AS BIGINT) AS time_waited
        FROM $counter_days""",
    "snapshots": """
        SELECT inst_id % 2 + 1 AS dbid, inst_id AS instance_number, snap_id, day AS begin_interval_time,
               day + INTERVAL 1 DAY AS end_interval_time,
               CASE WHEN snap_id < 16 THEN CAST('2024-01-01 00:00:00' AS $NTZ)
                    ELSE CAST('2024-01-16 00:00:00' AS $NTZ) END AS startup_time,
               'db' || (inst_id % 2 + 1) AS db_name, 'host' || inst_id || '.example.org' AS host_name
        FROM (SELECT DISTINCT user_id % 4 + 1 AS inst_id, CAST(extract(day FROM ts) AS BIGINT) AS snap_id,
                     CAST(CAST(ts AS DATE) AS $NTZ) AS day FROM $events) d""",
    # Cumulative wait counts per day and millisecond bucket; one bucket lies between two powers of two.
    "latency_days": """
        SELECT event_type AS event_name, CAST(extract(day FROM ts) AS BIGINT) AS snap_id,
               CASE WHEN value <= 1 THEN 1 WHEN value <= 2 THEN 2 WHEN value <= 3 THEN 3 WHEN value <= 4 THEN 4 WHEN value <= 8 THEN 8
                    WHEN value <= 16 THEN 16 WHEN value <= 32 THEN 32 WHEN value <= 64 THEN 64
                    WHEN value <= 128 THEN 128 WHEN value <= 256 THEN 256 ELSE 512 END AS wait_time_milli,
               count(*) AS n
        FROM $events GROUP BY 1, 2, 3""",
    "latency_hist": """
        SELECT event_name, snap_id, CAST(wait_time_milli AS BIGINT) AS wait_time_milli,
               CAST(sum(n) OVER (PARTITION BY event_name, wait_time_milli,
                        CASE WHEN snap_id < 16 THEN 0 ELSE 1 END ORDER BY snap_id) AS BIGINT) AS wait_count
        FROM $latency_days""",
    # Sessions wait on the session with half their number, so the waits form a forest.
    "sessions": """
        SELECT c_custkey % 3 + 1 AS inst_id, c_custkey AS sid, c_custkey * 3 + 1 AS serial_no,
               'S' || c_custkey AS saddr, 'P' || c_custkey AS paddr,
               CASE WHEN c_mktsegment = 'FURNITURE' THEN NULL ELSE c_name END AS username,
               CASE WHEN c_acctbal >= 3000 THEN 'ACTIVE' ELSE 'INACTIVE' END AS status,
               c_mktsegment AS program, lower(c_mktsegment) AS module, 'host' || c_nationkey AS machine,
               'os' || c_nationkey AS osuser,
               CASE WHEN c_nationkey < 6 THEN 'enq: TM - contention'
                    WHEN c_nationkey < 12 THEN 'enq: TX - row lock contention'
                    WHEN c_nationkey < 15 THEN 'SQL*Net message from client'
                    WHEN c_nationkey < 20 THEN 'db file sequential read' ELSE 'log file sync' END AS event,
               CASE WHEN c_acctbal < 1000 THEN 'WAITED KNOWN TIME' ELSE 'WAITING' END AS state,
               'sql' || c_custkey AS sql_id, 'A' || c_custkey AS sql_address, c_custkey AS sql_hash_value,
               CAST(floor(abs(c_acctbal)) AS BIGINT) * 3 AS last_call_et,
               CAST(floor(abs(c_acctbal) / 10) AS BIGINT) AS seconds_in_wait,
               CAST('2024-01-01 00:00:00' AS $NTZ) + CAST(floor(abs(c_acctbal)) AS BIGINT) * INTERVAL '1' SECOND
                   AS logon_time,
               CASE WHEN c_custkey > 1 AND c_acctbal < 8000 THEN CAST(floor(c_custkey / 2) AS BIGINT) END
                   AS blocking_session,
               CASE WHEN c_custkey > 1 AND c_acctbal < 8000 THEN CAST(floor(c_custkey / 2) AS BIGINT) % 3 + 1 END
                   AS blocking_instance,
               CAST(floor(abs(c_acctbal) * 10) AS BIGINT) AS p1
        FROM $customer""",
    "processes": """
        SELECT c_custkey % 3 + 1 AS inst_id, 'P' || c_custkey AS addr, CAST(c_custkey + 1000 AS VARCHAR(20)) AS spid
        FROM $customer WHERE c_acctbal > -900""",
    # Four neighbouring orders share a resource.
    "locks": """
        SELECT o_custkey % 3 + 1 AS inst_id, o_custkey AS sid,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'TM' WHEN '2-HIGH' THEN 'TX' ELSE 'TX' END AS lock_type,
               CAST(floor(o_orderkey / 4) AS BIGINT) AS id1,
               CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END AS id2,
               CASE o_orderstatus WHEN 'F' THEN 6 WHEN 'P' THEN 3 ELSE 0 END AS lmode,
               CASE o_orderstatus WHEN 'O' THEN 6 ELSE 0 END AS request,
               CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS is_blocking,
               CAST(floor(o_totalprice / 100) AS BIGINT) AS ctime,
               o_orderkey AS lock_no
        FROM $orders""",
    # The same session ids on three instances, as a cluster hands them out.
    "cluster_locks": """
        SELECT inst_id, CAST(floor(sid / 3) AS BIGINT) AS sid, lock_type, id1, id2, lmode, request, is_blocking, ctime, lock_no FROM $locks""",
    "cluster_sessions": """
        SELECT c_custkey % 3 + 1 AS inst_id, CAST(floor(c_custkey / 3) AS BIGINT) AS sid, c_name AS username,
               'db' || (c_custkey % 3 + 1) AS machine FROM $customer""",
    # Lock identities with missing parts, as relation locks and transaction locks have.
    "pg_locks": """
        SELECT o_custkey AS pid,
               CASE WHEN o_orderpriority = '1-URGENT' THEN 'relation' ELSE 'transactionid' END AS locktype,
               CASE WHEN o_orderpriority = '1-URGENT' THEN 5 END AS database,
               CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(floor(o_orderkey / 4) AS BIGINT) END AS relation,
               CAST(NULL AS BIGINT) AS page, CAST(NULL AS BIGINT) AS tuple, CAST(NULL AS BIGINT) AS virtualxid,
               CASE WHEN o_orderpriority <> '1-URGENT' THEN CAST(floor(o_orderkey / 4) AS BIGINT) END AS transactionid,
               CAST(NULL AS BIGINT) AS classid, CAST(NULL AS BIGINT) AS objid, CAST(NULL AS BIGINT) AS objsubid,
               o_orderstatus <> 'O' AS granted
        FROM $orders""",
    "pg_activity": """
        SELECT c_custkey AS pid, c_name AS usename,
               CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'idle' WHEN 'BUILDING' THEN 'idle in transaction'
                    ELSE 'active' END AS state,
               CASE WHEN c_mktsegment = 'MACHINERY' THEN 'autovacuum: VACUUM t' || c_nationkey
                    ELSE 'select ' || c_nationkey END AS query,
               '10.0.0.' || c_nationkey AS client_addr,
               CAST('2024-01-31 00:00:00' AS $NTZ) - CAST(floor(abs(c_acctbal) / 8) AS BIGINT) * INTERVAL '1' SECOND
                   AS query_start,
               CAST('2024-01-31 00:00:00' AS $NTZ) - CAST(floor(abs(c_acctbal) / 4) AS BIGINT) * INTERVAL '1' SECOND
                   AS xact_start
        FROM $customer""",
    "pg_user_tables": """
        SELECT CASE WHEN p_size < 5 THEN 'pg_toast' WHEN p_size < 8 THEN 'pg_catalog' ELSE 'app' END AS schemaname,
               'rel' || p_partkey AS relname, p_partkey AS relid,
               CAST(coalesce(ins, 0) AS BIGINT) AS n_tup_ins, CAST(coalesce(upd, 0) AS BIGINT) AS n_tup_upd,
               CAST(coalesce(del, 0) AS BIGINT) AS n_tup_del,
               CAST(coalesce(ins, 0) + coalesce(upd, 0) AS BIGINT) AS n_live_tup, CAST(coalesce(dead, 0) AS BIGINT) AS n_dead_tup,
               coalesce(del, 0) - coalesce(del, 0) % 3 AS seq_scan,
               coalesce(upd, 0) - coalesce(upd, 0) % 5 AS idx_scan, last_vacuum, last_analyze
        FROM $part LEFT JOIN (
            SELECT l_partkey, sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS ins,
                   sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS upd,
                   sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS del,
                   sum(CASE WHEN l_returnflag = 'R' THEN CAST(floor(l_quantity) AS BIGINT) ELSE 0 END) AS dead,
                   max(l_shipdate) AS last_vacuum, min(l_shipdate) AS last_analyze
            FROM $lineitem GROUP BY l_partkey) l ON l_partkey = p_partkey""",
    "pg_class": """
        SELECT p_partkey AS oid, CAST(p_size AS BIGINT) % 10 AS relnamespace, 'rel' || p_partkey AS relname,
               CASE WHEN p_partkey % 2 = 0 THEN 'r' ELSE 'i' END AS relkind,
               CAST(floor(p_retailprice) AS BIGINT) * 37 AS reltuples,
               CAST(p_size AS BIGINT) * 11 AS relpages,
               CAST(floor(p_retailprice * 1000) AS BIGINT) * p_size AS table_bytes,
               CAST(floor(p_retailprice * 100) AS BIGINT) * p_size AS index_bytes
        FROM $part""",
    "pg_namespace": """
        SELECT DISTINCT CAST(p_size AS BIGINT) % 10 AS oid,
               CASE CAST(p_size AS BIGINT) % 10 WHEN 0 THEN 'pg_catalog' WHEN 1 THEN 'pg_toast'
                    WHEN 2 THEN 'information_schema' ELSE 'app' END AS nspname
        FROM $part WHERE p_size <> 19""",
    "pg_index": """
        SELECT p_partkey - 1 AS indrelid, p_partkey AS indexrelid FROM $part
        WHERE p_partkey % 2 = 1 AND p_size > 10""",
    "pg_stats": """
        SELECT CASE CAST(p_size AS BIGINT) % 10 WHEN 0 THEN 'pg_catalog' WHEN 1 THEN 'pg_toast'
                    WHEN 2 THEN 'information_schema' ELSE 'app' END AS schemaname,
               'rel' || p_partkey AS tablename, 'c' || l_linenumber AS attname,
               CAST(round(CASE WHEN min(l_discount) > 0.02 THEN min(l_discount) ELSE 0 END * 100) AS BIGINT) AS null_pct,
               CAST(max(l_quantity) AS BIGINT) AS avg_width
        FROM $part JOIN $lineitem ON l_partkey = p_partkey WHERE p_partkey % 2 = 0
        GROUP BY p_partkey, p_size, l_linenumber""",
    "archived_log": """
        SELECT o_custkey % 2 + 1 AS inst_id, o_custkey % 2 + 1 AS thread_no, o_orderkey AS sequence_no,
               CASE WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 1 END AS dest_id,
               CASE WHEN o_orderstatus = 'P' THEN 'NO' ELSE 'YES' END AS archived,
               CASE WHEN o_orderstatus = 'F' THEN 'YES' ELSE 'NO' END AS applied,
               o_orderdate + (o_orderkey % 86400) * INTERVAL '1' SECOND AS first_time,
               o_orderdate + (o_orderkey % 86400 + CAST(floor(o_totalprice) AS BIGINT)) * INTERVAL '1' SECOND
                   AS completion_time,
               CAST(512 AS BIGINT) AS block_size, CAST(floor(o_totalprice) AS BIGINT) AS bytes
        FROM $orders""",
    "activity_samples": """
        SELECT user_id % 3 + 1 AS inst_id, ts AS sample_time, user_id AS session_id, event_id,
               CASE WHEN event_type = 'view' THEN NULL ELSE user_id % 7 END AS qc_session_id,
               user_id AS user_id, 'sql' || user_id AS sql_id,
               CASE event_type WHEN 'view' THEN 'SQL*Net message to client' WHEN 'click' THEN 'db file sequential read'
                    WHEN 'error' THEN 'enq: TX - row lock contention' WHEN 'signup' THEN 'log file sync'
                    ELSE 'pmon timer' END AS event,
               CASE WHEN event_type = 'click' THEN NULL ELSE event_type END AS module,
               'program' || (user_id % 5) AS program,
               CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS current_obj,
               CAST(floor(value) AS BIGINT) AS wait_time, CAST(floor(value * 10) AS BIGINT) AS time_waited,
               CAST(floor(value * 100) AS BIGINT) * 1048576 AS temp_space_allocated,
               CAST(floor(value * 100) AS BIGINT) * 1024 AS pga_allocated
        FROM $events""",
    "objects": """
        SELECT p_partkey AS object_id, p_brand AS owner, p_name || ' ' || p_partkey AS object_name,
               CASE WHEN p_size % 2 = 0 THEN 'TABLE' ELSE 'INDEX' END AS object_type,
               CASE WHEN p_size > 40 THEN 'P' || p_size END AS subobject_name,
               CASE WHEN p_size = 13 THEN 'INVALID' ELSE 'VALID' END AS status, p_size AS flags
        FROM $part""",
    # Two segments per part: its table and an index that is sometimes the larger of the two.
    "segments": """
        SELECT p_brand AS owner, 'T' || p_partkey AS segment_name, 'TABLE' AS segment_type,
               p_type AS tablespace_name, CAST(floor(p_retailprice * 1000000) AS BIGINT) AS bytes FROM $part
        UNION ALL
        SELECT p_brand, 'T' || p_partkey, 'TABLE PARTITION', p_type, CAST(p_size AS BIGINT) * 1000000 FROM $part
        UNION ALL
        SELECT p_brand, 'I' || p_partkey, 'INDEX', p_type, CAST(p_size AS BIGINT) * 60000000 FROM $part""",
    "indexes": """
        SELECT p_brand AS owner, 'I' || p_partkey AS index_name, p_brand AS table_owner,
               'T' || p_partkey AS table_name,
               CASE WHEN p_size = 7 THEN 'UNUSABLE' ELSE 'VALID' END AS status FROM $part""",
    "tab_statistics": """
        SELECT p_brand AS owner,
               'T' || p_partkey || CASE WHEN p_size < 4 THEN '_TEMP' WHEN p_size < 7 THEN '_TEMP_X'
                                        WHEN p_size < 10 THEN 'XTEMPX' ELSE '' END AS table_name,
               p_partkey AS object_id,
               CASE WHEN p_type = 'PROMO' THEN 'PARTITION' ELSE 'TABLE' END AS object_type,
               CASE WHEN p_retailprice >= 950 THEN 'YES' ELSE 'NO' END AS stale_stats,
               CASE WHEN p_size = 20 THEN 'ALL' END AS stattype_locked,
               CAST(p_size AS BIGINT) * 100 AS num_rows,
               CASE WHEN p_size > 45 THEN 'Y' ELSE 'N' END AS temporary,
               p_size BETWEEN 40 AND 42 AS is_external
        FROM $part""",
    "sequences": """
        SELECT p_brand AS sequence_owner, 'SEQ' || p_partkey AS sequence_name, CAST(1 AS BIGINT) AS min_value,
               CAST(p_size AS BIGINT) * 100 AS max_value,
               CAST(floor(p_retailprice * p_size / 11) AS BIGINT) AS last_number FROM $part""",
    "log_groups": """
        SELECT s_suppkey AS group_no, CAST(s_nationkey + 1 AS BIGINT) * 1048576 AS bytes, 2 AS members FROM $supplier""",
    "control_files": """
        SELECT s_suppkey AS file_no, 16384 AS block_size, CAST(s_nationkey + 10 AS BIGINT) AS blocks FROM $supplier""",
    "cells": "SELECT 'cell' || s_nationkey AS cell_name FROM $supplier",
    "component_schemas": """
        SELECT s_name AS host, CASE WHEN s_suppkey % 2 = 0 THEN 'catalog' ELSE 'machine' END AS type,
               CAST(480 + s_suppkey * 5 AS VARCHAR(10)) AS version, s_suppkey * 5 + 480 AS schema_no FROM $supplier""",
    "wait_chains": """
        SELECT CAST(floor(c_custkey / 5) AS BIGINT) AS chain_id, c_custkey AS waiter, c_nationkey AS instance,
               CASE WHEN c_acctbal < 6000 THEN c_nationkey % 3 + 1 END AS blocker_instance,
               c_nationkey + 1 AS p1, c_nationkey * 2 AS p2, CAST(NULL AS BIGINT) AS p3, c_nationkey % 7 AS since_last_wait_secs,
               c_mktsegment || '<=' || c_nationkey AS chain_signature,
               CASE WHEN c_acctbal < 3000 THEN CAST(floor(c_custkey / 5) AS BIGINT) + 1 END AS blocker_chain_id,
               CASE WHEN c_acctbal < 6000 THEN c_custkey + 1 END AS blocker,
               CASE WHEN c_acctbal > 5000 THEN c_nationkey % 4 ELSE 0 END AS num_waiters,
               CAST(floor(abs(c_acctbal) / 100) AS BIGINT) AS in_wait_secs, c_mktsegment AS wait_event_text
        FROM $customer""",
    # Snapshot history of events and of the time model, for the share-of-time check.
    "event_history": """
        SELECT inst_id % 2 + 1 AS dbid, inst_id AS instance_number, snap_id, name AS event_name,
               time_waited * 200000 AS time_waited_micro, total_waits FROM $counter_snapshots""",
    "time_model": """
        SELECT inst_id % 2 + 1 AS dbid, inst_id AS instance_number, snap_id, 'DB time' AS stat_name,
               CAST(sum(time_waited) AS BIGINT) * 200000 AS value FROM $counter_snapshots GROUP BY 1, 2, 3
        UNION ALL
        SELECT inst_id % 2 + 1, inst_id, snap_id, 'Parse Time', time_waited * 180000 FROM $counter_snapshots
        WHERE name = 'view'""",
    # --- frames for the health reports
    "databases": """
        SELECT upper(s_name) AS name, 'U' || s_suppkey AS unq_name, CASE WHEN s_acctbal < 0 THEN 'MOUNTED' ELSE 'READ WRITE' END
                   AS open_mode, 'ARCHIVELOG' AS log_mode, 'Linux x86 64-bit' AS platform_name, s_suppkey * 1000 AS scn,
               CASE WHEN s_suppkey % 5 = 0 THEN 'PHYSICAL STANDBY' ELSE 'PRIMARY' END AS database_role,
               CASE WHEN s_suppkey % 2 = 0 THEN 'YES' ELSE 'NO' END AS flashback_on
        FROM $supplier""",
    "db_instances": """
        SELECT s_suppkey % 3 + 1 AS inst_id, lower(s_name) AS instance_name, 'host' || s_suppkey || '.example.org' AS host_name,
               s_nationkey || '.2' AS version, s_suppkey AS instance_number,
               'PRIMARY_INSTANCE' AS instance_role, CASE WHEN s_suppkey % 9 = 0 THEN 'RESTRICTED' ELSE 'ALLOWED' END AS logins,
               CAST('2024-01-01 00:00:00' AS $NTZ) + s_suppkey * INTERVAL '1' HOUR AS startup_time
        FROM $supplier WHERE s_nationkey > 1""",
    "parameters": """
        SELECT s_suppkey % 3 + 1 AS inst_id, CASE WHEN s_nationkey < 8 THEN 'memory_target' WHEN s_nationkey < 16 THEN 'sga_target'
               ELSE 'pga_aggregate_target' END AS name, CAST(floor(abs(s_acctbal)) AS BIGINT) * 1048576 AS value
        FROM $supplier
        UNION ALL SELECT s_suppkey % 3 + 1, 'db_block_size', 8192 FROM $supplier""",
    "data_files": """
        SELECT p_type || (p_size % 7) AS tablespace_name, p_partkey AS file_no,
               CAST(floor(p_retailprice * 10000) AS BIGINT) AS bytes FROM $part""",
    "free_space": """
        SELECT p_type || (p_size % 7) AS tablespace_name, CAST(floor(p_retailprice) AS BIGINT) * p_size * 150 AS bytes
        FROM $part WHERE p_size % 7 <> 3""",
    "temp_files": """
        SELECT 'TEMP' || s_nationkey AS tablespace_name, CAST(floor(abs(s_acctbal)) AS BIGINT) * 1000 + 1 AS bytes
        FROM $supplier""",
    "temp_header": """
        SELECT 'TEMP' || s_nationkey AS tablespace_name,
               CAST(floor(abs(s_acctbal)) AS BIGINT) * 300 AS bytes_free, CAST(floor(abs(s_acctbal)) AS BIGINT) * 700 AS bytes_used
        FROM $supplier""",
    "osstat": """
        SELECT c_custkey % 3 + 1 AS inst_id, CASE WHEN c_nationkey < 8 THEN 'NUM_CPU_CORES' WHEN c_nationkey < 16 THEN 'NUM_CPUS'
               ELSE 'PHYSICAL_MEMORY_BYTES' END AS stat_name, c_nationkey * CAST(67108864 AS BIGINT) AS value FROM $customer""",
    "components_registry": """
        SELECT s_suppkey AS comp_id, s_name AS comp_name, CASE WHEN s_acctbal < 0 THEN 'INVALID' ELSE 'VALID' END AS status,
               s_nationkey || '.0' AS version FROM $supplier""",
    "registry_history": """
        SELECT o_orderdate AS action_time, CASE WHEN o_orderstatus = 'F' THEN 'APPLY' ELSE 'ROLLBACK' END AS action,
               'SERVER' AS namespace, o_orderkey AS id, o_orderpriority AS comments FROM $orders""",
    "backup_jobs": """
        SELECT o_orderkey AS session_recid, o_orderkey * 2 AS session_stamp, o_orderdate AS start_time,
               o_orderdate + (o_orderkey % 7200) * INTERVAL '1' SECOND AS end_time,
               CAST(floor(o_totalprice) AS BIGINT) * 1024 AS output_bytes,
               CASE WHEN o_orderstatus = 'P' THEN 'FAILED' ELSE 'COMPLETED' END AS status, 'DB FULL' AS input_type,
               o_orderkey % 7200 AS elapsed_seconds FROM $orders""",
    "backup_sets": """
        SELECT l_orderkey AS session_recid, l_orderkey * 2 AS session_stamp,
               CASE l_returnflag WHEN 'A' THEN 'D' WHEN 'N' THEN 'I' ELSE 'L' END AS backup_type,
               CASE WHEN l_linestatus = 'O' THEN CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 END END AS incremental_level,
               CASE WHEN l_linenumber = 1 THEN 'YES' ELSE 'NO' END AS controlfile_included, l_linenumber AS pieces,
               CASE WHEN l_tax > 0.07 THEN 'YES' ELSE 'NO' END AS input_file_scan_only, l_suppkey % 3 + 1 AS inst_id
        FROM $lineitem""",
    "recovery_area": """
        SELECT s_name AS name, CAST(floor(abs(s_acctbal)) + 1 AS BIGINT) * 1073741824 AS space_limit,
               CAST(floor(abs(s_acctbal) * 0.8) AS BIGINT) * 1073741824 AS space_used,
               CAST(floor(abs(s_acctbal) * 0.1) AS BIGINT) * 1073741824 AS space_reclaimable FROM $supplier""",
    "disk_groups": """
        SELECT s_name AS group_name, s_suppkey AS group_number, CASE WHEN s_nationkey < 12 THEN 'NORMAL' ELSE 'EXTERN' END AS type,
               CASE WHEN s_acctbal < 0 THEN 'DISMOUNTED' ELSE 'MOUNTED' END AS state,
               CAST(floor(abs(s_acctbal)) AS BIGINT) + 10 AS total_mb, CAST(floor(abs(s_acctbal) * 0.4) AS BIGINT) AS free_mb
        FROM $supplier""",
    "memory_components": """
        SELECT p_name AS component, p_partkey AS component_no, CAST(floor(p_retailprice) AS BIGINT) * 1048576 AS current_size,
               CAST(p_size AS BIGINT) * 1048576 AS min_size, p_type AS last_oper_type FROM $part""",
    "sgastat": """
        SELECT p_partkey % 3 + 1 AS inst_id, p_type AS pool, CASE WHEN p_size < 10 THEN 'free memory' ELSE p_name END AS name,
               CAST(floor(p_retailprice * 100000) AS BIGINT) AS bytes FROM $part""",
    "log_files": """
        SELECT s_nationkey AS group_no, '/redo/' || s_name AS member, CASE WHEN s_acctbal < 0 THEN 'STANDBY' ELSE 'ONLINE' END AS type,
               s_suppkey * 7 AS sequence_no FROM $supplier""",
    "long_ops": """
        SELECT l_orderkey AS sid, l_linenumber AS serial_no, l_partkey AS target, l_suppkey AS opname,
               CAST(floor(l_quantity) AS BIGINT) AS totalwork, CAST(floor(l_quantity * (1 - l_discount)) AS BIGINT) AS sofar,
               CAST(floor(l_extendedprice / 100) AS BIGINT) AS elapsed_seconds, CAST(floor(l_extendedprice) AS BIGINT) % 600 AS time_remaining
        FROM $lineitem WHERE l_linestatus = 'O'""",
    "resource_limits": """
        SELECT s_suppkey % 3 + 1 AS inst_id, CASE WHEN s_nationkey < 8 THEN 'sessions' WHEN s_nationkey < 16 THEN 'processes'
               ELSE 'locks' END AS resource_name, s_suppkey AS current_utilization, s_suppkey * 2 AS max_utilization FROM $supplier""",
    "alert_log": """
        SELECT ts AS originating_timestamp, user_id % 3 + 1 AS inst_id, event_id,
               CASE WHEN event_type = 'view' THEN 'other' ELSE 'rdbms' END AS component_id,
               CASE event_type WHEN 'error' THEN 'ORA-' || (user_id + 600) || ': failed' ELSE 'ok ' || event_type END AS message_text,
               'host' || user_id AS host_id, '/adr/' || user_id AS adr_home FROM $events""",
    "system_event": """
        SELECT l_suppkey % 3 + 1 AS inst_id,
               CASE l_linenumber WHEN 1 THEN 'direct path read temp' WHEN 2 THEN 'direct path write' WHEN 3 THEN 'db file sequential read'
                    WHEN 4 THEN 'log file sync' WHEN 5 THEN 'pmon timer' WHEN 6 THEN 'SQL*Net message from client'
                    ELSE 'latch free' END AS event,
               CASE l_linenumber WHEN 1 THEN 'User I/O' WHEN 2 THEN 'User I/O' WHEN 3 THEN 'User I/O' WHEN 4 THEN 'Commit'
                    WHEN 5 THEN 'Idle' WHEN 6 THEN 'Idle' ELSE 'Concurrency' END AS wait_class,
               count(*) AS total_waits, CAST(sum(l_linenumber) AS BIGINT) AS total_timeouts,
               CAST(sum(CAST(floor(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS time_waited_micro
        FROM $lineitem GROUP BY 1, 2, 3""",
    "sys_time_model": """
        SELECT l_suppkey % 3 + 1 AS inst_id, CASE l_returnflag WHEN 'A' THEN 'background cpu time' WHEN 'N' THEN 'DB CPU'
               ELSE 'DB time' END AS stat_name, CAST(sum(CAST(floor(l_quantity) AS BIGINT)) * 10000 AS BIGINT) AS value
        FROM $lineitem GROUP BY 1, 2""",
    "sysmetric": """
        SELECT user_id % 3 + 1 AS inst_id, CASE event_type WHEN 'view' THEN 'Executions Per Sec' WHEN 'click' THEN 'Logons Per Sec'
               WHEN 'error' THEN 'Host CPU Usage Per Sec' ELSE 'Unlisted Metric' END AS metric_name, 'Per Second' AS metric_unit,
               CASE WHEN value < 30 THEN 2 ELSE 3 END AS group_id, value, event_id FROM $events""",
    "transactions": """
        SELECT o_custkey % 3 + 1 AS inst_id, 'S' || o_custkey AS ses_addr, o_orderkey % 50 AS xidusn,
               CAST(floor(o_totalprice / 10) AS BIGINT) AS used_ublk, o_orderkey AS used_urec FROM $orders WHERE o_orderstatus = 'O'""",
    "rollback_segments": """
        SELECT s_suppkey AS usn, '_SEG' || s_suppkey AS segment_name, s_suppkey * 8192 AS rssize,
               CASE WHEN s_acctbal < 0 THEN 'OFFLINE' ELSE 'ONLINE' END AS status FROM $supplier""",
    "sort_usage": """
        SELECT o_custkey % 3 + 1 AS inst_id, 'user' || o_custkey AS username, 'sql' || o_custkey AS sql_id, 'S' || o_custkey AS session_addr,
               'TEMP' || (o_custkey % 5) AS tablespace, CAST(floor(o_totalprice / 1000) AS BIGINT) AS blocks FROM $orders""",
    "tablespaces": """
        SELECT DISTINCT 'TEMP' || (s_nationkey % 5) AS tablespace_name, 8192 AS block_size FROM $supplier""",
    "sesstat": """
        SELECT o_custkey % 3 + 1 AS inst_id, o_custkey AS sid, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 2 END AS statistic_no,
               CAST(sum(floor(o_totalprice)) AS BIGINT) AS value FROM $orders GROUP BY 1, 2, 3""",
    "statname": """
        SELECT DISTINCT CASE o_orderstatus WHEN 'F' THEN 1 ELSE 2 END AS statistic_no,
               CASE o_orderstatus WHEN 'F' THEN 'CPU used by this session' ELSE 'redo size' END AS name FROM $orders""",
    "locked_objects": """
        SELECT c_custkey % 3 + 1 AS inst_id, c_custkey AS object_id, c_custkey AS session_id, c_nationkey % 8 AS locked_mode,
               CASE WHEN c_acctbal < 0 THEN NULL ELSE c_name END AS username, 'os' || c_nationkey AS os_user_name FROM $customer""",
    "sysstat": """
        SELECT l_suppkey % 3 + 1 AS inst_id, CASE l_linenumber WHEN 1 THEN 'gc blocks lost' WHEN 2 THEN 'gc cr blocks received'
               WHEN 3 THEN 'gc current blocks served' ELSE 'physical reads' END AS name,
               CAST(sum(CAST(floor(l_quantity) AS BIGINT)) AS BIGINT) AS value FROM $lineitem GROUP BY 1, 2""",
    "latches": """
        SELECT l_partkey % 3 + 1 AS inst_id, 'latch' || l_partkey AS name,
               CAST(sum(CASE WHEN l_discount > 0.01 THEN floor(l_quantity) ELSE 0 END) AS BIGINT) * 10 AS gets,
               CAST(sum(CASE WHEN l_returnflag = 'A' THEN l_linenumber ELSE 0 END) AS BIGINT) AS misses,
               CAST(sum(CASE WHEN l_returnflag = 'N' THEN l_linenumber ELSE 0 END) AS BIGINT) AS sleeps,
               CAST(sum(l_linenumber) AS BIGINT) AS spin_gets, count(*) AS sleep1,
               CAST(sum(CASE WHEN l_linestatus = 'O' THEN floor(l_quantity) ELSE 0 END) AS BIGINT) AS immediate_gets,
               CAST(sum(CASE WHEN l_tax > 0.06 THEN 1 ELSE 0 END) AS BIGINT) AS immediate_misses,
               CAST(sum(floor(l_extendedprice)) AS BIGINT) AS wait_time FROM $lineitem GROUP BY 1, 2""",
    "shared_cursors": """
        SELECT l_suppkey % 3 + 1 AS inst_id, 'sql' || l_suppkey AS sql_id FROM $lineitem
        WHERE l_returnflag = 'R' AND l_discount > 0.045""",
    "sql_profiles": """
        SELECT 'prof' || o_orderkey AS name, o_orderdate AS created, o_orderstatus AS status, o_orderpriority AS sql_text FROM $orders""",
    # --- collected cluster text
    "roster": """
        SELECT c_custkey + 1 AS id, 'node' || (c_custkey + 1) AS name,
               CASE WHEN c_acctbal < 2000 THEN 'Leaf' ELSE 'Hub' END AS role FROM $customer""",
    # Every node has two files; the second one's line numbers are far ahead, whatever the times.
    "cluster_log": """
        SELECT 'node' || (user_id + 1) AS node, 'log' || event_id % 2 AS file, event_id + event_id % 2 * 1000000000 AS line_no, ts,
               CAST(ts AS VARCHAR(40)) || ': ' || CASE event_type
                 WHEN 'signup' THEN CASE user_id % 4
                   WHEN 0 THEN 'clssgmCMReconfig: reconfiguration successful, incarnation 7 with 3 nodes, master node node' || (user_id + 1) || ', own number 1'
                   WHEN 1 THEN 'I AM THE NEW OCR MASTER at incar 4' WHEN 2 THEN 'NEW OCR MASTER IS ' || (user_id + 1)
                   ELSE 'CRSPE: PE MASTER NAME: node' || (user_id + 1) END
                 WHEN 'view' THEN CASE user_id % 6
                   WHEN 0 THEN 'I AM A STANDBY MASTER' WHEN 1 THEN 'CURRENT STANDBY SERVERS: node' || (user_id + 1)
                   WHEN 2 THEN 'ctsselect_msccb3: node' || (user_id + 1) || ' is the CTSS master'
                   WHEN 3 THEN 'Master change notification has received. New master: ' || (user_id + 1)
                   WHEN 4 THEN 'ONSPROC CssSemMM::tryMaster I am the master'
                   ELSE 'ONSNETPROC CssSemMM::tryMaster I am the master' END
                 WHEN 'click' THEN 'CRSPE:1: PE Role|State Update: old role [' || CASE WHEN value < 20 THEN 'SLAVE' ELSE 'INVALID' END ||
                   '] new [' || CASE WHEN value < 40 THEN 'MASTER' ELSE 'STANDBY' END || ']; old state [Starting] new [Running]'
                 WHEN 'error' THEN 'OCRMAS: Rank of OCR:[1]. Rank of ASM Instance:[2]. My Rank:[' ||
                   (CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 10) || ']. Min Rank:[' || (user_id % 10) || '].'
                 ELSE CASE user_id % 7
                   WHEN 0 THEN 'clssbnmc_PeriodicPing_CB: Sending a ping msg to host node' || (event_id % 90 + 1) || ', number 1, using handle'
                   WHEN 1 THEN 'clssscPipeConnect: Successfully connected to node with connection string gipcha://node' || (event_id % 90 + 1) || ':'
                   WHEN 2 THEN 'clssscPipeConnect: Initiated connect to node with connection string gipcha://node' || (event_id % 90 + 1) || ':bcm_x'
                   WHEN 3 THEN 'clssgmSendEventsToClients: Group haip.rim.cluster_interconnect.node' || (event_id % 90 + 1) || ', member count'
                   ELSE 'clssgmGetMemberAttr:grock #CSS_BCNG memnum ' || (event_id % 150 + 1) || ' attrtype 8 len 4 value (' || (user_id + 1) || '/1/0x1)' END
               END AS line
        FROM $events""",
    # Two lines per event: its time and what happened.
    "storage_log": """
        SELECT 'node' || (user_id % 3 + 1) AS node, 'alert' AS file, event_id * 2 AS line_no,
               CAST(CAST(CAST(ts AS DATE) AS $NTZ) AS VARCHAR(40)) AS line FROM $events
        UNION ALL
        SELECT 'node' || (user_id % 3 + 1), 'alert', event_id * 2 + 1,
               CASE WHEN event_type = 'view' THEN 'other line' ELSE 'NOTE: client c' || user_id || ' opening storage' END FROM $events""",
    "disks": """
        SELECT p_partkey % 100 AS group_number, p_partkey AS disk_no, '/dev/disk' || p_partkey AS path FROM $part""",
    "volumes": """
        SELECT 'VOL' || (p_partkey % 500) AS volume_name, p_partkey % 100 AS group_number,
               CASE WHEN p_size > 10 THEN '/mnt/' || p_type END AS mountpath, CASE WHEN p_size < 30 THEN p_type END AS usage,
               CASE WHEN p_size <> 5 THEN p_retailprice END AS size_mb FROM $part""",
    "storage_users": """
        SELECT s_suppkey AS group_number, 'client' || s_nationkey AS client FROM $supplier WHERE s_acctbal > 3000""",
    "text_lines": """
        SELECT 'node' || doc_id % 3 AS node, doc_id, 'doc ' || doc_id || ' ' || coalesce(source, '') || chr(10) || chr(10) || replace(replace(coalesce(text, ''), chr(13), ' '), chr(133), ' ') AS text
        FROM $documents""",
    "roster_lines": """
        SELECT c_custkey AS line_no, 'node' || c_custkey || '  ' || c_custkey || '  ' ||
               CASE WHEN c_acctbal < 0 THEN 'Inactive  None' WHEN c_acctbal < 4000 THEN 'Active  Leaf'
                    WHEN c_acctbal < 9500 THEN 'Active   Hub' ELSE 'broken' END AS line FROM $customer""",
    "css_lines": """
        SELECT 'node' || (c_custkey % 40) AS node, 'out' || c_nationkey % 2 AS file, c_custkey AS line_no, 'CRS-4678: Successful get ' ||
               CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'diagwait' WHEN 'BUILDING' THEN 'disktimeout' WHEN 'FURNITURE' THEN 'misscount'
                    WHEN 'HOUSEHOLD' THEN 'leafmisscount' ELSE 'reboottime' END || ' ' || (c_nationkey + 1) ||
               ' for Cluster Synchronization Services.' AS line FROM $customer""",
    "getif_lines": """
        SELECT 'node' || s_nationkey AS node, s_suppkey AS line_no, CASE WHEN s_acctbal < 0 THEN 'Only in OCR: eth' || s_suppkey
               ELSE 'eth' || s_suppkey || '  10.0.' || s_nationkey || '.0  global  public' END AS line FROM $supplier""",
    "iflist_lines": """
        SELECT 'node' || s_nationkey AS node, s_suppkey AS line_no, 'eth' || s_suppkey || '  10.0.' ||
               CASE WHEN s_acctbal > 8000 THEN 99 ELSE s_nationkey END || '.0  255.255.255.0' AS line FROM $supplier""",
    "location_lines": """
        SELECT 'node' || (p_partkey % 50) AS node, p_partkey AS line_no,
               ' ' || (p_partkey % 5 + 1) || '. ONLINE   ' || md5(p_brand) || ' (/dev/' || p_type || ') [' || p_brand || ']' AS line
        FROM $part""",
    "fact_lines": """
        SELECT 'node' || (o_custkey % 200) AS node, 'out' || o_custkey % 7 AS file, o_orderkey AS line_no, CASE o_orderkey % 11
               WHEN 1 THEN 'Clusterware version on node [n1] is [' || (o_custkey % 9 + 10) || '.2.0.1.0]'
               WHEN 2 THEN 'Clusterware version on node n1 is [' || (o_custkey % 9 + 10) || '.2.0.1.0]'
               WHEN 3 THEN 'Clusterware release version on the local node is [' || (o_custkey % 9 + 10) || '.2.0.1.0]'
               WHEN 4 THEN 'Listener MGMTLSNR is ' || CASE WHEN o_orderstatus = 'F' THEN 'enabled' ELSE 'disabled' END
               WHEN 5 THEN 'Instance -MGMTDB is running on node node' || o_custkey
               ELSE CASE o_orderpriority WHEN '1-URGENT' THEN 'Active version on the cluster is [' || (o_custkey % 9 + 10) || '.2.0.1.0]'
               WHEN '2-HIGH' THEN 'SCAN name: scan' || o_custkey || '.example.org, Network: 1'
               WHEN '3-MEDIUM' THEN 'Cluster is running in "' || CASE WHEN o_orderstatus = 'F' THEN 'flex' ELSE 'standard' END || '" mode'
               WHEN '4-NOT SPECIFIED' THEN 'Listener LISTENER is running on node(s): node' || o_custkey
               ELSE 'GNS domain: d' || o_custkey || '.example.org' END END AS line FROM $orders""",
    "db_config_lines": """
        SELECT 'db' || s_suppkey AS host, 1 AS line_no, 'Database name: db' || s_suppkey AS line FROM $supplier
        UNION ALL SELECT 'db' || s_suppkey, 2, 'Disk Groups: DATA' || s_nationkey || ',data' || s_nationkey || ',FRA' FROM $supplier
        UNION ALL SELECT 'db' || s_suppkey, 3, 'Database role: ' || CASE WHEN s_acctbal < 0 THEN '' ELSE 'PRIMARY' END FROM $supplier
        UNION ALL SELECT 'db' || s_suppkey, 4, 'Domain: example.org' FROM $supplier""",
    "monitor_answers": """
        SELECT s_suppkey AS node_order, s_nationkey % 4 AS cluster_no, CASE WHEN s_acctbal < 4000 THEN 'old key' ELSE 'new key' END AS question,
               CASE WHEN s_nationkey < 10 THEN '' ELSE 'node' || s_suppkey END AS answer,
               CASE WHEN s_acctbal < 4000 THEN '11.2.0.4' ELSE '12.1.0.2' END AS version FROM $supplier""",
    "instance_roster_lines": """
        SELECT 'node' || (p_partkey % 300) AS node, 'out' || p_size % 2 AS file, p_partkey AS line_no, CASE WHEN p_size < 10 THEN '+ASM' || (p_partkey % 9) || ':/home:N'
               ELSE '# other' END AS line FROM $part""",
    "process_lines": """
        SELECT 'node' || (p_partkey % 300) AS node, 'out' || p_size % 2 AS file, p_partkey AS line_no, CASE WHEN p_size > 20 THEN 'grid 1 asm_pmon_+ASM' || (p_partkey % 9)
               ELSE 'root 2 init' END AS line FROM $part""",
    "param_lines": """
        SELECT s_suppkey AS line_no, CASE WHEN s_nationkey < 8 THEN 'EM_CELLS=(cel' || s_suppkey || ' cel' || s_nationkey || 'b )'
               WHEN s_nationkey < 14 THEN 'swiib' || s_suppkey || '.name=sw' || s_suppkey WHEN s_nationkey < 20 THEN 'pdu1 name=pdu' || s_suppkey
               ELSE 'OTHER=1' END AS line FROM $supplier""",
    # Stanzas of three lines and a blank one; some lack a field.
    "stanza_lines": """
        SELECT 'node' || (c_nationkey % 2) AS node, c_custkey * 4 AS line_no, 'NAME=vip' || c_custkey AS line FROM $customer
        UNION ALL SELECT 'node' || (c_nationkey % 2), c_custkey * 4 + 1, CASE WHEN c_acctbal < 0 THEN 'STATE=x' ELSE 'ADDRESS: 10.0.0.' || c_nationkey END FROM $customer
        UNION ALL SELECT 'node' || (c_nationkey % 2), c_custkey * 4 + 2, 'version=' || c_mktsegment FROM $customer
        UNION ALL SELECT 'node' || (c_nationkey % 2), c_custkey * 4 + 3, '' FROM $customer""",
    # Profiles of cluster resources: virtual addresses of nodes and other resources.
    "profile_lines": """
        SELECT 'node' || s_nationkey % 3 AS node, s_suppkey * 4 AS line_no, CASE WHEN s_acctbal < 0 THEN 'NAME=ora.db' || s_suppkey || '.db'
               ELSE 'NAME=ora.host' || s_suppkey || '.vip' END AS line FROM $supplier
        UNION ALL SELECT 'node' || s_nationkey % 3, s_suppkey * 4 + 1, CASE WHEN s_nationkey < 4 THEN 'TYPE=other' WHEN s_nationkey < 14 THEN
               'USR_ORA_VIP=10.0.' || s_nationkey || '.' || s_suppkey % 200 ELSE 'USR_ORA_VIP=vip' || s_suppkey || '.example.org' END FROM $supplier
        UNION ALL SELECT 'node' || s_nationkey % 3, s_suppkey * 4 + 2, 'VERSION=12.1.0.' || s_nationkey FROM $supplier
        UNION ALL SELECT 'node' || s_nationkey % 3, s_suppkey * 4 + 3, '' FROM $supplier""",
    # Lists that run side by side; those of one node in four have not the same length.
    "listener_lines": """
        SELECT 'node' || s_suppkey % 40 AS node, s_suppkey * 3 AS line_no, 'Name: listener' || s_suppkey AS line FROM $supplier
        UNION ALL SELECT 'node' || s_suppkey % 40, s_suppkey * 3 + 1, 'Subnet: 10.' || s_nationkey || '.0.0' FROM $supplier
        UNION ALL SELECT 'node' || s_suppkey % 40, s_suppkey * 3 + 2, CASE WHEN s_suppkey % 4 = 0 AND s_suppkey < 30 THEN 'no listener'
               WHEN s_acctbal < 0 THEN 'Listener is stopped.' ELSE 'Listener is running.' END FROM $supplier""",
    # Jobs with the session that runs them; some jobs are not running.
    "running_jobs": """
        SELECT s_suppkey AS job_no, s_suppkey % 3 + 1 AS inst_id, CASE WHEN s_acctbal > 0 THEN s_suppkey * 7 END AS sid, s_nationkey % 3 AS failures,
               CAST('2024-01-20 00:00:00' AS $NTZ) + s_nationkey * INTERVAL '1' HOUR AS this_date,
               CAST('2024-01-19 00:00:00' AS $NTZ) + s_nationkey * INTERVAL '1' HOUR AS last_date FROM $supplier""",
    "compaction_log": """
        SELECT 'exec' || (user_id % 4) AS thread, event_id AS line_no, ts AS logged_at, event_type,
               CASE event_type WHEN 'signup' THEN 'CompactionTask - Compacting [files]' WHEN 'view' THEN 'CompactionTask - Compacting [files]'
                    WHEN 'error' THEN 'CompactionTask - Compacted to [file]' WHEN 'click' THEN 'CompactionTask - Compacted to [file]'
                    ELSE 'flush' END AS line FROM $events""",
    "ttl_rows": """
        SELECT o_orderkey AS key, CASE o_orderstatus WHEN 'F' THEN 'short' WHEN 'O' THEN 'long' ELSE 'none' END AS table_name,
               o_orderdate AS write_ts, CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(3600 AS BIGINT) END AS ttl FROM $orders""",
    "declared_hosts": """
        SELECT s_name AS host_name, '10.1.0.' || s_nationkey AS ip, 'example.org' AS domain FROM $supplier""",
    "resolved_hosts": """
        SELECT s_name AS host_name, '10.1.0.' || CASE WHEN s_acctbal > 8000 THEN 99 ELSE s_nationkey END AS ip,
               CASE WHEN s_acctbal < 1000 THEN 'other.org' ELSE 'EXAMPLE.org' END AS domain FROM $supplier WHERE s_nationkey <> 5""",
    "host_domains": """
        SELECT c_custkey AS host_id, CASE WHEN c_nationkey < 8 THEN 'example.org' WHEN c_nationkey < 12 THEN '(none)' ELSE 'other.org' END AS found,
               CASE WHEN c_acctbal < 2000 THEN '' WHEN c_acctbal < 6000 THEN 'example.org' ELSE 'other.org' END AS configured FROM $customer""",
    "node_ciphers": """
        SELECT 'node' || c_custkey AS node, CASE WHEN c_nationkey < 8 THEN 'aes128-ctr, aes256-ctr' WHEN c_nationkey < 16 THEN 'aes256-cbc,3des-cbc'
               ELSE '3des-cbc' END AS ciphers FROM $customer""",
    # --- the monitored fleet: ten hosts, one database per customer
    "fleet_targets": """
        SELECT 'db' || c_custkey || '_site' AS target_name, 'host' || (c_custkey % 10) || '.example.org' AS machine_name FROM $customer""",
    "fleet_metrics": """
        SELECT CASE WHEN event_type IN ('view', 'click') THEN 'host' || (user_id % 10) || CASE WHEN user_id % 3 = 0 THEN '' ELSE '.example.org' END
                    ELSE 'db' || user_id || '_site' END AS entity_name,
               CASE WHEN event_type IN ('view', 'click') THEN 'host' ELSE 'oracle_database' END AS entity_type,
               CASE event_type WHEN 'view' THEN CASE k % 3 WHEN 0 THEN 'CPU Utilization (%)' WHEN 1 THEN 'Swap Utilization (%)'
                                                          ELSE 'Total Disk I/O made across all disks (per second)' END
                    WHEN 'click' THEN 'Filesystem Space Available (%)' WHEN 'signup' THEN 'Tablespace Space Used (%)'
                    WHEN 'error' THEN 'Total Foreground Wait Time (second)' ELSE 'Database Time Spent Waiting (%)' END AS metric_column_label,
               CASE event_type WHEN 'view' THEN ' ' WHEN 'click' THEN CASE k % 5 WHEN 0 THEN '/' WHEN 1 THEN '/u0' WHEN 2 THEN '/u1' WHEN 3 THEN '/u2'
                                                          ELSE '/u0/arch' END
                    WHEN 'signup' THEN 'ts' || (k % 4) WHEN 'error' THEN 'event ' || (k % 6) ELSE 'class ' || (k % 3) END AS metric_key_value,
               ts AS collection_time, value
        FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM $events) e""",
    "fleet_thresholds": """
        SELECT 'db' || c_custkey || '_site' AS target_name, 'ts' || (c_custkey % 4) AS key_value, '50' AS warning_threshold,
               '80' AS critical_threshold FROM $customer
        UNION ALL SELECT 'db' || c_custkey || '_site', ' ', '30', '60.5' FROM $customer WHERE c_acctbal > 2000
        UNION ALL SELECT 'db' || c_custkey || '_site', 'ts3', ' ', NULL FROM $customer""",
    "fleet_datafiles": """
        SELECT 'HOST' || (c_custkey % 10) || '.example.org' AS host_name, 'db' || c_custkey || '_site' AS target_name,
               CASE WHEN c_nationkey < 5 THEN '+DG/data.dbf' ELSE '/u' || (c_custkey % 3) || '/data.dbf' END AS file_name,
               '/u' || (c_custkey % 3) AS os_storage_entity FROM $customer""",
    "fleet_parameters": """
        SELECT 'host' || (c_custkey % 10) || '.example.org' AS host_name, 'db' || c_custkey || '_site' AS target_name,
               CASE WHEN c_nationkey < 3 THEN 'log_archive_dest_state_1' WHEN c_nationkey < 6 THEN 'db_recovery_file_dest'
                    ELSE 'log_archive_dest_1' END AS name,
               CASE WHEN c_nationkey < 6 THEN '/u1/fra' WHEN c_nationkey < 10 THEN 'SERVICE=standby' WHEN c_nationkey < 12
                    THEN 'LOCATION=USE_DB_RECOVERY_FILE_DEST' WHEN c_nationkey < 18 THEN 'location=/u0/arch/' || chr(36) || 'ORACLE_SID'
                    ELSE 'LOCATION=/u' || (c_custkey % 3) || 'x/log' END AS value FROM $customer
        UNION ALL
        SELECT 'host' || (c_custkey % 10) || '.example.org', 'db' || c_custkey || '_site', 'log_archive_dest_2',
               '/u' || (c_custkey % 3) || '/second' FROM $customer WHERE c_acctbal < 5000""",
    "fleet_standby": """
        SELECT 'db' || c_custkey || '_site' AS target_name, 'Apply Lag (seconds)' AS column_label, CAST(c_nationkey AS VARCHAR(9)) AS value
        FROM $customer WHERE c_acctbal > 4000
        UNION ALL SELECT 'db' || c_custkey || '_site', 'Transport Lag (seconds)', CAST(c_nationkey * 2 AS VARCHAR(9)) FROM $customer
        WHERE c_acctbal > 6000""",
    "metric_values": """
        SELECT 'host' || user_id || CASE WHEN event_type = 'view' THEN '' ELSE '.example.org' END AS entity_name,
               CASE WHEN event_type IN ('view', 'click') THEN 'host' ELSE 'database' END AS entity_type,
               event_type AS metric_column_label,
               'key' || (CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 4) AS metric_key_value,
               ts AS collection_time, event_id, user_id, value
        FROM $events""",
    "log_lines": """
        SELECT 'node' || (user_id % 3 + 1) AS node, 'log_' || (user_id % 3 + 1) || '.txt' AS file, event_id AS line_no, ts,
               CAST(ts AS VARCHAR(40)) || ' [' || (user_id % 9) || '] ' ||
               CASE event_type
                    WHEN 'signup' THEN 'leader: new owner is node ' || (user_id % 3 + 1)
                    WHEN 'error' THEN 'leader: this node has become owner'
                    WHEN 'purchase' THEN 'registry writer is node number ' || (user_id % 3 + 1) || ' now'
                    WHEN 'click' THEN 'state changed from ' || CASE WHEN value < 20 THEN 'IDLE' ELSE 'BUSY' END ||
                                      ' to ' || CASE WHEN value < 40 THEN 'UP' ELSE 'DOWN' END
                    ELSE 'rank: my rank ' || (user_id % 10) || ' min rank ' ||
                         (CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 10) END AS line
        FROM $events""",
    "status_lines": """
        SELECT s_name AS host, 1 AS line_no,
               CASE WHEN s_nationkey < 12 THEN 'Slave_IO_Running: ' ELSE 'Replica_IO_Running: ' END ||
               CASE WHEN s_acctbal < 0 THEN 'No' WHEN s_acctbal < 1000 THEN 'Connecting' ELSE 'Yes' END AS line
        FROM $supplier
        UNION ALL
        SELECT s_name, 2, CASE WHEN s_nationkey < 12 THEN '  Slave_SQL_Running: ' ELSE 'Replica_SQL_Running: ' END ||
               CASE WHEN s_nationkey = 3 THEN 'No' ELSE 'Yes' END FROM $supplier
        UNION ALL
        SELECT s_name, 3, CASE WHEN s_nationkey < 12 THEN 'Seconds_Behind_Master: ' ELSE 'Seconds_Behind_Source: ' END ||
               CASE WHEN s_acctbal > 9000 THEN 'NULL' WHEN s_acctbal > 5000 THEN '0'
                    ELSE CAST(s_nationkey * 2 AS VARCHAR(9)) END FROM $supplier
        UNION ALL
        SELECT s_name, 4, 'Last_SQL_Error: ' || CASE WHEN s_nationkey = 7 THEN 'row: not found' ELSE '' END
        FROM $supplier
        UNION ALL
        SELECT s_name, 5, 'not a field line' FROM $supplier""",
    # Saved pages with attributes that hold a bracket, and references to characters.
    "saved_pages": """
        SELECT page_id, CASE page_id % 4 WHEN 0 THEN '<p title="a > b" class=''x>y''>caf&eacute; &#8212; &#x41;&#151;&amp;lt; 1 < 2</p>' || html
                        WHEN 1 THEN html || '<div data-q="</p>">&euro;&unknown; R&D</div><!-- <b>"x" > --><br/>end'
                        WHEN 2 THEN '<script>if (a > "</p>") x();</script><style>p > b</style>' || html ELSE html END AS html FROM $pages""",
    "mounts": """
        SELECT host AS target, '/' || host AS mount FROM
            (SELECT DISTINCT split_part(url, '/', 3) AS host FROM $pages) h
        UNION ALL
        SELECT DISTINCT split_part(url, '/', 3), '/' || split_part(url, '/', 3) || '/' || split_part(url, '/', 4)
        FROM $pages WHERE split_part(url, '/', 4) IN ('en', 'fr')""",
    "mounted_paths": """
        SELECT page_id, split_part(url, '/', 3) AS target,
               '/' || split_part(url, '/', 3) || '/' || split_part(url, '/', 4) || '/' ||
               split_part(split_part(split_part(url, '/', 5), '?', 1), '#', 1) AS path
        FROM $pages""",
    "components": """
        SELECT CAST(s_suppkey AS VARCHAR(20)) AS id, CASE WHEN s_nationkey < 8 THEN 'cell' WHEN s_nationkey < 16 THEN 'switch'
                    ELSE 'compute' END AS type, lower(substring(s_name, 1, 8)) || s_suppkey AS host_name,
               'example.org' AS admin_domain,
               CASE WHEN s_acctbal < 0 THEN '' WHEN s_acctbal < 2000 THEN 'other.example.org' ELSE 'example.org' END
                    AS client_domain,
               '10.1.' || CAST(floor(s_suppkey / 250) AS BIGINT) || '.' || s_suppkey % 250 AS admin_ip,
               CASE WHEN s_acctbal > 5000 THEN '10.2.' || CAST(floor(s_suppkey / 250) AS BIGINT) || '.' ||
                    s_suppkey % 250 ELSE '' END AS client_ip,
               'adm' || s_suppkey AS admin_name,
               CASE WHEN s_nationkey > 4 THEN 'cli' || s_suppkey ELSE '' END AS client_name
        FROM $supplier""",
    "components_other": """
        SELECT id, type, host_name FROM $components WHERE client_domain <> ''
        UNION ALL
        SELECT id, type, host_name || 'x' FROM $components WHERE client_domain = ''""",
    "versions": """
        SELECT p_partkey AS host_id, 'host' || p_partkey AS host,
               CASE WHEN p_size < 15 THEN 'cell' WHEN p_size < 30 THEN 'switch' WHEN p_size < 45 THEN 'agent'
                    ELSE 'tool' END AS type,
               p_size || '.' || (p_partkey % 20) || CASE WHEN p_type = 'PROMO' THEN '' ELSE '.' || (p_partkey % 3) END ||
               CASE WHEN p_type = 'ECONOMY' THEN '-' || (p_partkey % 4) ELSE '' END AS version,
               p_size AS v1, p_partkey % 20 AS v2, CASE WHEN p_type = 'PROMO' THEN -1 ELSE p_partkey % 3 END AS v3,
               CASE WHEN p_type = 'ECONOMY' THEN CAST(p_partkey % 4 AS VARCHAR(4)) ELSE '' END AS sfx
        FROM $part""",
    # Three replicas of most rows; the second one lags for cheap orders and lacks some, the third one has not compacted all.
    "replica_writes": """
        SELECT 1 AS replica, 'dc1' AS dc, o_orderkey, o_orderpriority AS payload, o_orderdate AS write_ts, o_orderstatus, o_orderpriority,
               o_orderdate FROM $orders
        UNION ALL
        SELECT 2, 'dc1', o_orderkey, CASE WHEN o_totalprice < 20000 THEN 'old' ELSE o_orderpriority END,
               CASE WHEN o_totalprice < 20000 THEN o_orderdate - INTERVAL 1 DAY ELSE o_orderdate END, o_orderstatus, o_orderpriority,
               o_orderdate FROM $orders WHERE o_orderkey % 40 <> 7
        UNION ALL
        SELECT 3, 'dc2', o_orderkey, 'older', o_orderdate - INTERVAL 5 DAY, o_orderstatus, o_orderpriority, o_orderdate FROM $orders
        WHERE o_orderkey % 10 = 3
        UNION ALL
        SELECT 3, 'dc2', o_orderkey, o_orderpriority, o_orderdate, o_orderstatus, o_orderpriority, o_orderdate FROM $orders""",
    # Two copies of a table: the second one lacks some rows, has others besides, and holds some with another value.
    "copied_rows": """
        SELECT 'a' AS copy, o_orderkey AS key, o_custkey AS part_key, o_orderpriority AS payload, o_orderdate AS write_ts FROM $orders
        UNION ALL
        SELECT 'b', CASE WHEN o_orderkey % 101 = 5 THEN -o_orderkey ELSE o_orderkey END, o_custkey,
               CASE WHEN o_orderkey % 89 = 2 THEN NULL ELSE o_orderpriority END, o_orderdate FROM $orders WHERE o_orderkey % 97 <> 3""",
    # Rows in partitions: some hold no tombstones, one holds nothing else.
    "parted_rows": """
        SELECT key, replica, payload, write_ts, deleted_at,
               CASE WHEN deleted_at IS NOT NULL AND key % 5 = 0 THEN 'a/b: dead' WHEN key % 7 = 1 AND deleted_at IS NULL THEN 'live'
                    ELSE 'part ' || key % 3 END AS part FROM $versioned_rows""",
    # Waits of sessions with up to three blockers; some wait for those that wait for them.
    "wait_edges": """
        SELECT 's' || CAST(floor(c_custkey / 2) AS BIGINT) AS blocker, 's' || c_custkey AS waiter FROM $customer WHERE c_custkey > 1 AND c_acctbal < 8000
        UNION ALL SELECT 's' || c_custkey * 2, 's' || c_custkey FROM $customer WHERE c_nationkey = 3
        UNION ALL SELECT 's' || (c_custkey + 5), 's' || c_custkey FROM $customer WHERE c_nationkey = 4
        UNION ALL SELECT 's' || c_custkey, 's' || c_custkey FROM $customer WHERE c_nationkey = 6 AND c_acctbal < 0
        UNION ALL SELECT 'ring' || ((c_custkey % 50 + 1) % 50), 'ring' || c_custkey % 50 FROM $customer""",
    "versioned_rows": """
        SELECT o_orderkey AS key, replica, dc, payload, write_ts,
               CASE WHEN o_orderstatus = 'P' THEN o_orderdate END AS deleted_at,
               CASE o_orderpriority WHEN '1-URGENT' THEN o_orderdate + INTERVAL 10 DAY
                    WHEN '2-HIGH' THEN o_orderdate + INTERVAL 400 DAY END AS expires_at
        FROM $replica_writes""",
}


def render(text: str, dialect: str) -> str:
    """``text`` with every ``$name`` filled in: shapes as subqueries, base tables as ``{name}`` for Spark or plain."""

    def fill(match: re.Match) -> str:
        name = match.group(1)
        if name == "NTZ":
            return "TIMESTAMP_NTZ" if dialect == "spark" else "TIMESTAMP"
        if name in BASE_TABLES:
            return f"{{{name}}}" if dialect == "spark" else name
        return f"({render(SHAPES[name], dialect)})"

    return re.sub(r"\$([A-Za-z_]+)", fill, text)


class Tables:
    """Base tables and shapes as attributes: ``tables.orders``, ``tables.sessions``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return read_table(self.spark, f"{self.sf_dir}/{name}.parquet", BASE_TABLES[name])
        if name in SHAPES:
            return self.sql(SHAPES[name])
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        """A SELECT over tables and shapes."""
        rendered = render(text, "spark")
        used = set(re.findall(r"\{([a-z]+)\}", rendered))
        return self.spark.sql(rendered, **{name: getattr(self, name) for name in used})
