"""Database health reports. Each is a function from tables to one result frame; times come in as ``as_of``."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.functions.exprs import decode, duration_hms, exhaustion_pct, safe_ratio
from tidemark.operators import graph
from tidemark.operators.aggregates import percent_of_total, with_totals
from tidemark.operators.checks import sequence_gap
from tidemark.operators.filters import since, trailing_window
from tidemark.operators.joins import any_one
from tidemark.operators.ranking import rank_top, top_n
from tidemark.operators.skew import lookup_join, semi_lookup

MB = 1024 * 1024
GB = 1024 * MB

# Events that only mean a session has nothing to do.
IDLE_EVENTS = (
    "rdbms ipc message", "smon timer", "pmon timer", "SQL*Net message from client",
    "lock manager wait for remote message", "ges remote message", "gcs remote message", "gcs for action",
    "client message", "pipe get", "null event", "PX Idle Wait", "single-task message", "PX Deq: Execution Msg",
    "KXFQ: kxfqdeq - normal deqeue", "listen endpoint status", "slave wait", "wakeup time manager",
)

# Events left out of the object wait report.
OBJECT_WAIT_EXCLUDED = (
    "queue messages", "rdbms ipc message", "rdbms ipc reply", "pmon timer", "smon timer", "jobq slave wait",
    "wait for unread message on broadcast channel", "wakeup time manager",
)

# Metrics of the load profile.
LOAD_METRICS = (
    "Average Active Sessions", "Average Synchronous Single-Block Read Latency", "CPU Usage Per Sec",
    "Background CPU Usage Per Sec", "DB Block Changes Per Txn", "Executions Per Sec", "Host CPU Usage Per Sec",
    "I/O Megabytes per Second", "I/O Requests per Second", "Logical Reads Per Txn", "Logons Per Sec",
    "Network Traffic Volume Per Sec", "Physical Reads Per Sec", "Physical Reads Per Txn", "Physical Writes Per Sec",
    "Redo Generated Per Sec", "Redo Generated Per Txn", "Response Time Per Txn", "SQL Service Response Time",
    "Total Parse Count Per Txn", "User Calls Per Sec", "User Transaction Per Sec",
)

# What the lock codes mean.
LOCK_TYPES = {
    "RT": "Redo Log Buffer", "TD": "Dictionary", "TM": "DML", "TS": "Temp Segments", "TX": "Transaction",
    "UL": "User", "RW": "Row Wait",
}
LOCK_MODES = {
    0: "None", 1: "Null", 2: "Row Share", 3: "Row Excl.", 4: "Share", 5: "S/Row Excl.", 6: "Exclusive",
}
LOCK_MODES_SHORT = {1: "    ", 2: "RS", 3: "RX", 4: "S", 5: "SRX", 6: "X"}
LOCK_MODES_LONG = {
    0: "None", 1: "Null (NULL)", 2: "Row-S (SS)", 3: "Row-X (SX)", 4: "Share (S)", 5: "S/Row-X (SSX)",
    6: "Exclusive (X)",
}


def _facts(facts: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """``(item, value)`` rows from frames of one value each."""
    rows = [
        df.toDF("value").select(F.lit(item).alias("item"), F.col("value").cast("string").alias("value"))
        for item, df in facts
    ]
    return reduce(DataFrame.unionByName, rows)


# --- identity, configuration, recovery


def identity(databases: DataFrame, instances: DataFrame) -> DataFrame:
    """Databases with the instance of the same name."""
    named = instances.withColumn("name", F.upper("instance_name"))
    return databases.join(named, "name").select(
        "name", "unq_name", F.date_format("startup_time", "dd-MM-yy HH:mm:ss").alias("starttime"), "open_mode",
        "instance_role", "log_mode", F.col("scn").cast("string").alias("scn"), "database_role", "flashback_on", "version", "logins",
    )


def configuration_summary(
    databases: DataFrame, instances: DataFrame, parameters: DataFrame, data_files: DataFrame, temp_files: DataFrame,
    log_groups: DataFrame, control_files: DataFrame, osstat: DataFrame, cells: DataFrame, processor: str,
) -> DataFrame:
    """Names, sizes, memory and hardware as item and value rows; one aggregate per source table.

    Every database and every version in use has a row. ``processor`` is the model that the operating system tells.
    """
    nodes = instances.agg(F.count("*").alias("n")).select(
        F.when(F.col("n") == 1, "Single-instance").otherwise(F.concat(F.col("n"), F.lit("-node cluster"))).alias("v")
    )
    node_text = nodes.scalar()
    files = data_files.agg(
        F.sum("bytes").alias("bytes"), F.count("*").alias("files"), F.count_distinct("tablespace_name").alias("spaces")
    )
    temp_bytes = temp_files.select(F.sum("bytes")).scalar()
    log_bytes = log_groups.select(F.sum("bytes") * F.max("members")).scalar()
    control_bytes = control_files.select(F.sum(F.col("block_size") * F.col("blocks"))).scalar()
    total = F.col("bytes") + temp_bytes + log_bytes + control_bytes
    size = files.select(F.format_string("%.3f TB", F.round(total / 1e12, 3)))
    blocks = parameters.filter("name = 'db_block_size'").agg(F.concat((F.max("value") / 1024).cast("int").cast("string"), F.lit(" KB")))
    servers = cells.agg(F.count_distinct("cell_name").alias("n")).select(
        F.when(F.col("n") > 0, F.concat(F.lit("Engineered System with "), "n", F.lit(" storage servers"))).otherwise("Unknown")
    )

    def target(name: str) -> Column:
        return F.sum(F.when(F.col("name") == name, F.col("value")))

    memory = parameters.agg(
        target("memory_target").alias("mem"), target("sga_target").alias("sga"),
        target("pga_aggregate_target").alias("pga"),
    )

    def part(label: str, name: str) -> Column:
        shown = F.format_string(f"{label} %.1f GB, ", F.round(F.col(name) / float(GB), 1))
        return F.when(F.col(name) > 0, shown).otherwise("")

    management = F.when(F.col("mem") > 0, "AMM").when(F.col("sga") > 0, "ASMM").otherwise("MANUAL")
    memory = memory.select(F.concat(part("MEMORY", "mem"), part("SGA", "sga"), part("PGA", "pga"), management))

    def machine(name: str) -> Column:
        return F.sum(F.when(F.col("stat_name") == name, F.col("value")))

    hardware = osstat.agg(
        machine("NUM_CPU_CORES").alias("cores"), machine("NUM_CPUS").alias("cpus"),
        machine("PHYSICAL_MEMORY_BYTES").alias("ram"),
    )
    ram = F.format_string("%.1f GB", F.round(F.col("ram") / float(GB), 1))
    return _facts([
        ("Database name:", databases.select("name")),
        ("Database version:", instances.select("version").distinct()),
        ("Database block size:", blocks),
        ("Database size:", size),
        ("Datafiles:", files.select(F.concat("files", F.lit(" (on "), "spaces", F.lit(" tablespaces)")))),
        ("Database configuration:", nodes),
        ("Database memory:", memory),
        ("Hardware:", servers),
        ("Processor:", nodes.select(F.lit(processor))),
        ("Physical CPUs:", hardware.select(F.concat("cores", F.lit(" cores, on "), node_text))),
        ("CPUs:", hardware.select(F.concat("cpus", F.lit(" CPUs (threads), on "), node_text))),
        ("Physical RAM:", hardware.select(F.concat(ram, F.lit(", on "), node_text))),
        ("Operating system:", databases.agg(F.max("platform_name"))),
    ])


def standby_gap(archived_log: DataFrame, instances: DataFrame) -> DataFrame:
    """Log gap per thread with the instance that writes it."""
    names = instances.groupBy(F.col("inst_id").alias("thread_no")).agg(F.min("instance_name").alias("db_name"))
    return sequence_gap(archived_log).join(names, "thread_no")


def backup_jobs(jobs: DataFrame, sets: DataFrame, as_of: Column, days: int = 8) -> DataFrame:
    """Backup jobs since ``days`` days before the day of ``as_of``, with pieces per backup type."""
    key = ["session_recid", "session_stamp"]
    kind = F.concat_ws("", "backup_type", F.col("incremental_level").cast("string"))
    pieces = F.col("pieces")

    def count(condition: Column, name: str) -> Column:
        return F.sum(F.when(condition, pieces).otherwise(0)).alias(name)

    read = sets.filter("input_file_scan_only = 'NO'")
    control = F.col("controlfile_included")
    per_job = read.groupBy(*key).agg(
        count(control == "YES", "cf"), count((control == "NO") & (kind == "D"), "df"), count(kind == "D0", "i0"),
        count(kind == "I1", "i1"), count(F.col("backup_type") == "L", "l"),
    )
    outputs = sets.groupBy(*key).agg(F.min("inst_id").alias("output_instance"))
    recent = jobs.filter(F.col("start_time") > F.date_trunc("day", as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL '{days}' DAY"))
    return (
        recent.join(per_job, key, "left").join(outputs, key, "left")
        .withColumn("output_mbytes", F.col("output_bytes") / MB)
        .withColumn("dow", F.date_format("start_time", "EEEE"))
        .drop("output_bytes").orderBy("start_time", *key)
    )


def recovery_area(area: DataFrame) -> DataFrame:
    limit, used, free = F.col("space_limit"), F.col("space_used"), F.col("space_reclaimable")
    return area.select(
        "name", (limit / GB).alias("space_limit_gb"), ((limit - used + free) / GB).alias("space_available_gb"),
        F.round((used - free) / limit * 100, 1).alias("percent_full"),
    )


def tablespace_usage(data_files: DataFrame, free_space: DataFrame, temp_files: DataFrame, temp_header: DataFrame) -> DataFrame:
    """Size and use of permanent and temporary tablespaces; both sides are summed before they meet."""
    size = data_files.groupBy("tablespace_name").agg(F.sum("bytes").alias("bytes"))
    free = free_space.groupBy("tablespace_name").agg(F.sum("bytes").alias("free"))
    temp_size = temp_files.groupBy("tablespace_name").agg(F.sum("bytes").alias("bytes"))
    temp_free = temp_header.groupBy("tablespace_name").agg(F.sum("bytes_free").alias("free"))
    both = size.join(free, "tablespace_name", "left").unionByName(temp_size.join(temp_free, "tablespace_name", "left"))
    return both.select(
        "tablespace_name", (F.col("bytes") / MB).alias("size_mb"), (F.col("free") / MB).alias("free_mb"),
        F.coalesce(F.round(F.col("free") * 100 / F.col("bytes"), 0), F.lit(1.0)).alias("pct_free"),
        F.round((F.col("bytes") - F.col("free")) * 100 / F.col("bytes"), 0).alias("pct_used"),
    ).orderBy(F.col("pct_free").desc(), "tablespace_name")


def disk_group_usage(groups: DataFrame) -> DataFrame:
    """Use of every disk group and, with ``total_level`` 1, the grand total."""
    used = groups.withColumn("used_mb", F.col("total_mb") - F.col("free_mb"))
    sums = with_totals(used, ["group_name"], ["total_mb", "used_mb"])
    return sums.withColumn("pct_used", F.round(F.col("used_mb") / F.col("total_mb") * 100, 2))


def memory_components(components: DataFrame) -> DataFrame:
    return components.select(
        "component_no", "component", (F.col("current_size") / MB).alias("current_mb"),
        (F.col("min_size") / MB).alias("min_mb"), F.col("last_oper_type").alias("type"),
    )


def memory_usage(sgastat: DataFrame) -> DataFrame:
    """Used, free and total memory in one pass."""
    free = F.col("name") == "free memory"

    def size(value: Column) -> Column:
        return F.round(F.sum(value) / float(GB), 2)

    return sgastat.agg(
        size(F.when(~free, F.col("bytes"))).alias("sga_used_gb"), size(F.when(free, F.col("bytes"))).alias("sga_free_gb"),
        size(F.col("bytes")).alias("sga_total_gb"),
    )


def running_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs that a session is running, the longest running first."""
    return jobs.filter("sid IS NOT NULL").orderBy("this_date", "job_no")


def occupants(segments: DataFrame) -> DataFrame:
    """Space per occupant, those with none left out."""
    used = segments.groupBy(F.col("owner").alias("occupant")).agg(F.sum("bytes").alias("bytes"))
    return used.filter("bytes > 0").select("occupant", (F.col("bytes") / MB).alias("mb")).orderBy("mb", "occupant")


def long_operations(ops: DataFrame) -> DataFrame:
    return ops.filter("totalwork <> sofar").withColumn("elapsed_min", F.col("elapsed_seconds") / 60).drop(
        "elapsed_seconds"
    ).orderBy(F.col("time_remaining").desc(), "sid", "serial_no", "target")


# --- sessions


def session_sql(sessions: DataFrame, sqlarea: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sessions with the statement they run, matched on instance, address and hash."""
    statements = sqlarea.select(
        "inst_id", F.col("address").alias("sql_address"), F.col("hash_value").alias("sql_hash_value"), *columns
    )
    return lookup_join(sessions, statements, ["inst_id", "sql_address", "sql_hash_value"], "inner")


def in_flight(sessions: DataFrame, sqlarea: DataFrame, event_like: str | None = None) -> DataFrame:
    """Active user sessions with their statement and how long they have run; the report's own statement is left out."""
    active = sessions.filter("status = 'ACTIVE' AND username IS NOT NULL")
    if event_like:
        active = active.filter(F.col("event").like(event_like))
    joined = session_sql(active, sqlarea, ["plan_hash_value", "disk_reads", "buffer_gets", "rows_processed", "sql_text"])
    longest_first = [F.col("last_call_et").desc(), F.col("inst_id"), F.col("sid")]
    return joined.filter(~F.col("sql_text").like("%in_flight report%")).orderBy(*longest_first).select(
        "inst_id", "sid", "serial_no", "username", "sql_id", "plan_hash_value", "disk_reads", "buffer_gets",
        "rows_processed", "event", "osuser", "program", "module", "machine", "seconds_in_wait", "state", "sql_text",
        F.date_format("logon_time", "MM-dd-yyyy HH:mm:ss").alias("logontime"),
        duration_hms(F.col("last_call_et")).alias("running_since"),
    )


def with_process(sessions: DataFrame, processes: DataFrame) -> DataFrame:
    """Sessions that have a server process."""
    return sessions.join(processes.select("inst_id", F.col("addr").alias("paddr"), "spid"), ["inst_id", "paddr"])


def session_counts(sessions: DataFrame, processes: DataFrame, idle_seconds: int = 10800) -> DataFrame:
    """Inactive, long inactive and active sessions in one pass."""
    inactive = F.col("status") == "INACTIVE"
    return with_process(sessions, processes).agg(
        F.count_if(inactive).alias("inactive_sessions"),
        F.count_if(inactive & (F.col("last_call_et") > idle_seconds)).alias("long_inactive_sessions"),
        F.count_if(F.col("status") == "ACTIVE").alias("active_sessions"),
    )


def _long_inactive(sessions: DataFrame, processes: DataFrame, idle_seconds: int) -> DataFrame:
    kept = sessions.filter((F.col("status") == "INACTIVE") & (F.col("last_call_et") > idle_seconds))
    return with_process(kept, processes)


def inactive_by_program(sessions: DataFrame, processes: DataFrame, idle_seconds: int = 10800) -> DataFrame:
    counts = _long_inactive(sessions, processes, idle_seconds).groupBy("program").agg(F.count("program").alias("inactive_sessions"))
    return counts.orderBy(F.col("inactive_sessions").desc(), "program")


def inactive_detail(
    sessions: DataFrame, processes: DataFrame, sqlarea: DataFrame, idle_seconds: int = 10800, width: int | None = None
) -> DataFrame:
    """Long inactive sessions with their last statement, cut or filled to ``width`` characters if one is given."""
    shown = F.col("sql_text") if width is None else F.lpad("sql_text", width, " ")
    rows = session_sql(_long_inactive(sessions, processes, idle_seconds), sqlarea, ["disk_reads", "sql_text"])
    return rows.select(
        "spid", "sid", "serial_no", (F.col("last_call_et") / 3600).alias("last_call_hours"), "status", "module",
        "program", "disk_reads", shown.alias("last_sql"),
    ).orderBy("last_call_hours", "sid", "spid")


def sequence_exhaustion(sequences: DataFrame, excluded_owners: Sequence[str], limit: float = 90) -> DataFrame:
    used = exhaustion_pct(F.col("last_number"), F.col("min_value"), F.col("max_value"))
    rows = sequences.filter(~F.col("sequence_owner").isin(list(excluded_owners)) & (F.col("max_value") > 0))
    return rows.withColumn("percent_used", used).filter(F.col("percent_used") > limit).orderBy(
        F.col("percent_used").desc(), "sequence_owner", "sequence_name"
    )


def alert_errors(alert_log: DataFrame, as_of: Column) -> DataFrame:
    recent = alert_log.filter(since(F.col("originating_timestamp"), as_of, 86400))
    errors = recent.filter((F.col("component_id") == "rdbms") & F.col("message_text").like("%ORA-%"))
    newest_first = [F.col("originating_timestamp").desc(), *map(F.col, ("inst_id", "host_id", "message_text"))]
    return errors.orderBy(*newest_first).select(
        F.date_format("originating_timestamp", "dd.MM.yyyy HH:mm:ss").alias("message_time"), "inst_id", "message_text",
        "host_id", "adr_home",
    )


# --- waits and load


def current_waits(sessions: DataFrame) -> DataFrame:
    counts = sessions.groupBy("event", "state", "inst_id").agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), "event", "state", "inst_id")


def top_events(system_event: DataFrame, n: int = 10) -> DataFrame:
    busy = system_event.filter(~F.col("event").isin(list(IDLE_EVENTS)))
    shown = busy.select("inst_id", "event", "time_waited_micro", "total_waits", "total_timeouts")
    return top_n(shown, [F.col("time_waited_micro").desc(), F.col("event"), F.col("inst_id")], n)


def load_profile(sysmetric: DataFrame, group_id: int = 2) -> DataFrame:
    kept = sysmetric.filter(F.col("metric_name").isin(list(LOAD_METRICS)) & (F.col("group_id") == group_id))
    return kept.withColumn("w_metric_value", F.round("value", 2)).orderBy("metric_name", "inst_id", "value")


def undo_usage(transactions: DataFrame, sessions: DataFrame, rollback: DataFrame) -> DataFrame:
    owners = sessions.select("inst_id", F.col("saddr").alias("ses_addr"), "username", "sid", "serial_no")
    segments = rollback.withColumnRenamed("usn", "xidusn")
    owned = lookup_join(transactions, owners, ["inst_id", "ses_addr"], "inner")
    joined = lookup_join(owned, segments, ["xidusn"], "inner")
    return joined.select(
        "inst_id", "username", "sid", "serial_no", "used_ublk", "used_urec", "segment_name", "rssize", "status"
    ).orderBy(F.col("used_ublk").desc(), "inst_id", "sid", "used_urec")


def temp_usage(
    sort_usage: DataFrame, sqlarea: DataFrame, sessions: DataFrame, processes: DataFrame, tablespaces: DataFrame,
    least_blocks: int = 1000,
) -> DataFrame:
    """Temporary space per session and statement; summed and cut before the joins."""
    key = ["inst_id", "username", "sql_id", "tablespace", "session_addr"]
    big = sort_usage.groupBy(*key).agg(F.sum("blocks").alias("blocks")).filter(F.col("blocks") > least_blocks)
    owners = with_process(sessions, processes).select("inst_id", F.col("saddr").alias("session_addr"), "sid", "spid")
    texts = any_one(sqlarea, ["sql_id"], "sql_text")
    sizes = tablespaces.withColumnRenamed("tablespace_name", "tablespace")
    joined = big.join(owners, ["inst_id", "session_addr"]).join(texts, "sql_id").join(sizes, "tablespace")
    return joined.select(
        "username", "sid", "spid", "sql_id", "sql_text", "tablespace",
        (F.col("blocks") * F.col("block_size") / MB).alias("usage_mb"),
    ).orderBy("usage_mb", "sid", "sql_id", "tablespace")


def temp_by_statement(samples: DataFrame, as_of: Column, seconds: int = 7200, least: int = 5 * GB) -> DataFrame:
    recent = samples.filter(since(F.col("sample_time"), as_of, seconds) & (F.col("temp_space_allocated") > least))
    peak = recent.groupBy("sql_id").agg((F.max("temp_space_allocated") / GB).alias("gig"))
    return peak.orderBy(F.col("gig").desc(), "sql_id")


def waiting_sessions(sessions: DataFrame, sqlarea: DataFrame) -> DataFrame:
    """Sessions that wait for something, longest first."""
    waiting = sessions.filter(~F.col("event").isin(list(IDLE_EVENTS)) & (F.col("seconds_in_wait") > 0))
    statements = sqlarea.select("inst_id", F.col("address").alias("sql_address"), F.col("sql_text").alias("last_sql"))
    return lookup_join(waiting, statements, ["inst_id", "sql_address"], "inner").select(
        "inst_id", "sql_id", "sid", "state", "event", F.col("seconds_in_wait").alias("seconds"), "p1", "last_sql"
    ).orderBy(F.col("seconds").desc(), "inst_id", "sid")


def top_waiting_sql(samples: DataFrame, sqlarea: DataFrame, users: DataFrame, as_of: Column, n: int = 5) -> DataFrame:
    """Statements with most wait time in the last hour; samples are summed before the joins."""
    recent = samples.filter(trailing_window(F.col("sample_time"), as_of, 3600))
    sums = recent.groupBy("sql_id", "user_id").agg(F.sum(F.col("wait_time") + F.col("time_waited")).alias("ttl_wait_time"))
    # Sums by statement and user: a statement has at most one row per user, a user one per statement.
    joined = lookup_join(sums, any_one(sqlarea, ["sql_id"], "sql_text"), ["sql_id"], "inner")
    joined = lookup_join(joined, users, ["user_id"], "inner")
    best = joined.select("sql_id", "username", "sql_text", "ttl_wait_time")
    return top_n(best, [F.col("ttl_wait_time").desc(), F.col("sql_id"), F.col("username")], n)


# --- statements


def top_sql(
    sqlarea: DataFrame, measure: Column, shown: str, least: float, n: int = 10, per_execution: bool = True
) -> DataFrame:
    """Statements above ``least`` by ``measure``, ranked by it or by it per execution; no executions count as one."""
    kept = sqlarea.withColumn(shown, measure).filter(F.col(shown) > least)
    order = shown
    if per_execution:
        order = f"{shown}_per_exec"
        kept = kept.withColumn(order, safe_ratio(F.col(shown), F.col("executions")))
    columns = list(dict.fromkeys([
        "inst_id", "sql_id", "hash_value", "sql_text", "executions", "buffer_gets", "disk_reads", shown, order
    ]))
    return top_n(kept.select(*columns), [F.col(order).desc(), F.col("sql_id"), F.col("inst_id")], n, "rank")


def concurrency_sql(sqlarea: DataFrame, n: int = 10, width: int | None = None) -> DataFrame:
    """Statements with most concurrency wait: share of their own time and of all such waits.

    With ``width`` only so many first characters of a statement are shown.
    """
    text = F.col("sql_text") if width is None else F.substring("sql_text", 1, width)
    run = sqlarea.filter("elapsed_time > 0").withColumn(
        "con_time_pct", F.round(F.col("concurrency_wait_time") * 100 / F.col("elapsed_time"), 2)
    )
    shares = percent_of_total(run, "concurrency_wait_time", "pct_of_con_time")
    best = rank_top(shares, F.col("concurrency_wait_time"), n)
    return best.select(
        "sql_id", "inst_id", text.alias("sql_text"),
        (F.col("concurrency_wait_time") / 1000).alias("con_time_ms"), "con_time_pct", "pct_of_con_time", "rank",
    )


def cpu_sessions(sesstat: DataFrame, statname: DataFrame, sessions: DataFrame, processes: DataFrame, n: int = 15) -> DataFrame:
    """Active user sessions with most processor time."""
    cpu = statname.filter(F.col("name").like("%CPU used by this session%")).select("statistic_no")
    used = sesstat.filter("value > 0").join(cpu, "statistic_no", "left_semi")
    active = sessions.filter("status = 'ACTIVE' AND username IS NOT NULL AND username <> 'SYS'")
    rows = with_process(active, processes).join(used, ["inst_id", "sid"]).select(
        "spid", "sid", "serial_no", "inst_id", "sql_id", "username", "program", "machine",
        (F.col("value") / 100).alias("cpu_usage_seconds"),
    )
    return top_n(rows, [F.col("cpu_usage_seconds").desc(), F.col("sid")], n)


def wait_breakdown(system_event: DataFrame, time_model: DataFrame) -> DataFrame:
    """Wait time by type with processor time as a type of its own, each with its share."""
    event, wait_class = F.col("event"), F.col("wait_class")
    kind = (
        F.when(event.like("direct path% temp"), "direct path read / write temp")
        .when(event.like("direct path%"), "direct path read / write non-temp")
        .when(wait_class == "User I/O", event).otherwise(wait_class)
    )
    waits = system_event.select(kind.alias("wait_type"), "total_waits", "time_waited_micro")
    cpu = time_model.filter(F.col("stat_name").isin("background cpu time", "DB CPU")).select(
        F.lit("CPU").alias("wait_type"), F.lit(None).cast("bigint").alias("total_waits"),
        F.col("value").alias("time_waited_micro"),
    )
    sums = waits.unionByName(cpu).filter("wait_type <> 'Idle'").groupBy("wait_type").agg(
        F.sum("total_waits").alias("total_waits"), F.sum("time_waited_micro").alias("micro")
    )
    shares = percent_of_total(sums, "micro")
    return shares.select(
        "wait_type", "total_waits", F.round(F.col("micro") / 1e6, 2).alias("time_waited_seconds"), "pct"
    ).orderBy(F.col("pct").desc(), "wait_type")


# --- locks


def lock_tree(sessions: DataFrame) -> DataFrame:
    """The blocking tree of user sessions, as ``instance.session``."""
    waiting = sessions.filter("blocking_instance IS NOT NULL AND blocking_session IS NOT NULL AND username IS NOT NULL")
    edges = waiting.select(
        F.concat("blocking_instance", F.lit("."), "blocking_session").alias("blocker"),
        F.concat("inst_id", F.lit("."), "sid").alias("waiter"),
    )
    return graph.blocking_tree(edges).orderBy("path")


def lock_detail(locks: DataFrame, sessions: DataFrame, locked_objects: DataFrame, objects: DataFrame) -> DataFrame:
    """Locks on resources that somebody asks for, with decoded type and mode and the object behind them."""
    asked = semi_lookup(locks, locks.filter("request > 0"), ["id1", "id2", "lock_type"])
    held = locked_objects.select("inst_id", F.col("session_id").alias("sid"), "object_id")
    named = held.join(objects.select("object_id", "object_name"), "object_id")
    owners = sessions.select("inst_id", "sid", "serial_no", "program", "osuser", "machine")
    joined = lookup_join(asked, owners.join(named, ["inst_id", "sid"]), ["inst_id", "sid"], "inner")
    return joined.select(
        "lock_no", decode(F.col("is_blocking"), {0: "Waiting"}, "Blocking ->").alias("user_status"),
        F.concat(F.lit("'"), "sid", F.lit(","), "serial_no", F.lit("'")).alias("sid_serial"), "inst_id", "program",
        "osuser", "machine", decode(F.col("lock_type"), LOCK_TYPES, F.col("lock_type")).alias("lock_type"),
        decode(F.col("lmode"), LOCK_MODES, F.col("lmode").cast("string")).alias("lock_mode"), "ctime", "object_name",
        "id1", "id2",
    ).orderBy("id1", "id2", F.col("ctime").desc(), "lock_no")


LOCK_RESOURCE = ("lock_type", "id1", "id2")


# A session id is unique within its instance alone.
CLUSTER_SESSION = ("inst_id", "sid")


def who_blocks_whom(locks: DataFrame) -> DataFrame:
    """Waiting sessions with the session that has blocked them longest and the number of blockers."""
    return graph.blocked_by(
        locks, LOCK_RESOURCE, CLUSTER_SESSION, "is_blocking = 1", "request > 0", ["ctime", *CLUSTER_SESSION]
    )


def who_blocks_whom_text(locks: DataFrame, sessions: DataFrame) -> DataFrame:
    """The same as a sentence."""
    people = sessions.select(*CLUSTER_SESSION, F.concat_ws("@", "username", "machine").alias("who"))

    def named(found: DataFrame, side: str) -> DataFrame:
        who = people.select(*[F.col(c).alias(f"{side}_{c}") for c in CLUSTER_SESSION], F.col("who").alias(f"_{side}"))
        return lookup_join(found, who, [f"{side}_{c}" for c in CLUSTER_SESSION], "inner")

    both = named(named(who_blocks_whom(locks), "blocker"), "waiter")
    text = F.concat(
        "_blocker", F.lit(" ( SID="), "blocker_sid", F.lit(" )  is blocking "), "_waiter", F.lit(" ( SID="), "waiter_sid", F.lit(" ) ")
    )
    return both.select(*LOCK_RESOURCE, "n_blockers", text.alias("blocking_status"))


def lock_list(locks: DataFrame) -> DataFrame:
    yes = {0: "NO"}
    kept = locks.filter("request > 0 OR is_blocking = 1")
    return kept.select(
        "lock_no", "sid", "lock_type", decode(F.col("is_blocking"), yes, "YES").alias("blocker"),
        decode(F.col("request"), yes, "YES").alias("waiter"),
        decode(F.col("lmode"), LOCK_MODES_SHORT, "NONE").alias("held"),
        decode(F.col("request"), LOCK_MODES_SHORT, "NONE").alias("asked"),
        F.floor(F.col("ctime") / 60).alias("minutes"), "id1", "id2",
    )


def locked_objects(objects: DataFrame, locked: DataFrame) -> DataFrame:
    names = objects.select("object_id", F.col("owner").alias("object_owner"), "object_name")
    joined = lookup_join(locked, names, ["object_id"], "inner")
    return joined.select(
        "inst_id", F.col("session_id").alias("sid"), F.coalesce("username", F.lit("(none)")).alias("username"),
        "object_owner", "object_name",
        decode(F.col("locked_mode"), LOCK_MODES_LONG, F.col("locked_mode").cast("string")).alias("locked_mode"),
        "os_user_name",
    ).orderBy("inst_id", "sid", "username", "object_owner", "object_name")


# --- objects and waits on them


def top_object_waits(samples: DataFrame, objects: DataFrame, as_of: Column, n: int = 5) -> DataFrame:
    """Objects with most wait time in the last hour."""
    recent = samples.filter(trailing_window(F.col("sample_time"), as_of, 3600))
    sums = recent.groupBy(F.col("current_obj").alias("object_id"), "event").agg(
        F.sum(F.col("wait_time") + F.col("time_waited")).alias("wait")
    )
    named = lookup_join(sums, objects.select("object_id", "object_name", "object_type"), ["object_id"], "inner")
    totals = named.groupBy("object_name", "object_type", "event").agg(F.sum("wait").alias("ttl_wait_time"))
    return top_n(totals, [F.col("ttl_wait_time").desc(), F.col("object_name"), F.col("event")], n)


def object_waits(samples: DataFrame, objects: DataFrame, n: int = 30) -> DataFrame:
    """Object, statement and event combinations with most wait time."""
    event = F.col("event")
    kept = samples.filter(~event.isin(list(OBJECT_WAIT_EXCLUDED)) & ~event.like("SQL*Net%") & ~event.like("Backup%"))
    sums = kept.groupBy(F.col("current_obj").alias("object_id"), "sql_id", "module", "event").agg(
        F.count("*").alias("cnt"), F.sum(F.col("time_waited") + F.col("wait_time")).alias("twait")
    )
    named = sums.join(objects.select(
        "object_id", F.concat_ws(".", "owner", "object_name").alias("oname"), F.col("object_type").alias("otyp"),
        F.col("subobject_name").alias("sname"),
    ), "object_id").drop("object_id")
    return top_n(named, [F.col("twait").desc(), F.col("oname"), F.col("sql_id"), F.col("event"), F.col("module")], n)


def block_transfers(sysstat: DataFrame) -> DataFrame:
    name = F.col("name")
    kept = sysstat.filter(name.like("gc% lost") | name.like("gc% received") | name.like("gc% served"))
    return kept.groupBy("name").agg(F.sum("value").alias("value")).orderBy("name")


def latch_hit_ratio(latches: DataFrame, limit: float = 0.99) -> DataFrame:
    ratio = F.round(safe_ratio(F.col("gets") - F.col("misses"), F.col("gets")), 3)
    kept = latches.filter("gets <> 0").withColumn("hit_ratio", ratio).filter(F.col("hit_ratio") < limit)
    return kept.select(
        "inst_id", F.col("name").alias("latch_name"), "hit_ratio",
        F.round(safe_ratio(F.col("sleeps"), F.col("misses")), 3).alias("sleeps_per_miss"),
    ).orderBy("hit_ratio", "latch_name", "inst_id")


def latch_waits(latches: DataFrame, n: int = 10) -> DataFrame:
    busy = latches.filter("gets + misses + sleep1 + wait_time > 0")
    ranked = rank_top(busy, F.col("wait_time"), n, "misses_rank")
    return ranked.select(
        "name", "inst_id", "gets", "misses", F.round(F.col("misses") * 100 / (F.col("gets") + 1), 3).alias("misses_gets_pct"),
        "spin_gets", "sleep1", "wait_time", F.round(F.col("wait_time") / 1e6, 0).alias("wait_time_seconds"), "misses_rank",
    )


def wait_chain_report(chains: DataFrame, instances: DataFrame, n: int = 100) -> DataFrame:
    """The first ``n`` wait chains in words; the instance may be unknown."""

    def said(text: str, column: str, missing: str = "") -> Column:
        return F.concat(F.lit(text), F.coalesce(F.col(column).cast("string"), F.lit(missing)))

    # At most n rows are left before the join.
    named = instances.select(F.col("instance_number").alias("instance"), "instance_name")
    rows = graph.wait_chains(chains, n).join(named, "instance", "left")
    return rows.orderBy("chain_id", F.col("num_waiters").desc(), "waiter").select(
        said("Current Process: ", "waiter").alias("w_proc"), said("SID ", "instance_name").alias("instance"),
        said("INST #: ", "instance").alias("inst"),
        F.concat(said("Blocking Process: ", "blocker", "<none>"), said(" from Instance ", "blocker_instance")).alias("blocker_proc"),
        said("Number of waiters: ", "num_waiters").alias("waiters"), said("Wait Event: ", "wait_event_text").alias("wait_event"),
        *[said(f"{p.upper()}: ", p).alias(p) for p in ("p1", "p2", "p3")], said("Seconds in Wait: ", "in_wait_secs").alias("seconds"),
        said("Seconds Since Last Wait: ", "since_last_wait_secs").alias("sincelw"),
        F.concat(said("Wait Chain: ", "chain_id"), said(": ", "chain_signature")).alias("chain_signature"),
        said("Blocking Wait Chain: ", "blocker_chain_id", "<none>").alias("blocker_chain"),
    )


def latch_immediate(latches: DataFrame, limit: float = 0.99) -> DataFrame:
    tried = F.col("immediate_gets") + F.col("immediate_misses")
    kept = latches.filter(tried > 0).withColumn("hit_ratio", F.round(F.col("immediate_gets") / tried, 3))
    return kept.filter(F.col("hit_ratio") < limit).select(
        "inst_id", F.col("name").alias("latch_name"), "hit_ratio",
        F.round(safe_ratio(F.col("sleeps"), F.col("immediate_misses")), 3).alias("sleeps_per_miss"),
    ).orderBy("hit_ratio", "latch_name", "inst_id")


def unshared_cursors(cursors: DataFrame, sqlarea: DataFrame, least: int = 99) -> DataFrame:
    """Statements with more than ``least`` child cursors, ranked, with one of their texts."""
    counts = cursors.groupBy("sql_id").agg(F.count("*").alias("child_cursors")).filter(F.col("child_cursors") > least)
    # A rank is one plus the number of statements with more cursors: counted per distinct value.
    values = counts.groupBy("child_cursors").agg(F.count("*").alias("_n"))
    before = Window.orderBy(F.col("child_cursors").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranks = values.select("child_cursors", (F.coalesce(F.sum("_n").over(before), F.lit(0)) + 1).cast("int").alias("sql_rank"))
    ranked = lookup_join(counts, ranks, ["child_cursors"], "inner")
    texts = any_one(sqlarea, ["sql_id"], "sql_text")
    return ranked.join(texts, "sql_id", "left").orderBy("sql_rank", "sql_id")


def sql_profiles(profiles: DataFrame) -> DataFrame:
    return profiles.orderBy(F.col("created").desc(), "name")


def private_memory(samples: DataFrame, as_of: Column, seconds: int = 180, least: int = 2 * MB) -> DataFrame:
    kept = samples.filter((F.col("pga_allocated") > least) & since(F.col("sample_time"), as_of, seconds))
    in_time = [F.col("sample_time"), F.coalesce(F.col("qc_session_id"), F.lit(0)), F.col("session_id"), F.col("pga_allocated"), F.col("sql_id")]
    return kept.orderBy(*in_time).select(
        F.date_format("sample_time", "HH:mm:ss").alias("hhmmss"),
        F.coalesce(F.col("qc_session_id").cast("string"), F.lit("n/a")).alias("qc"), "inst_id",
        F.col("session_id").alias("sid"), (F.col("pga_allocated") / 1024).alias("kb"), "sql_id",
        F.coalesce("module", F.concat(F.lit("<"), "program", F.lit(">"))).alias("module"),
    )


def top_segments(segments: DataFrame, n: int = 10) -> DataFrame:
    key = ["owner", "segment_name", "segment_type", "tablespace_name"]
    sums = segments.groupBy(*key).agg(F.round(F.sum("bytes") / float(GB), 0).alias("size_in_gb"), F.sum("bytes").alias("bytes"))
    return top_n(sums, [F.col("bytes").desc(), *[F.col(c) for c in key]], n)


def indexes_over_tables(segments: DataFrame, indexes: DataFrame, least: int = 10**7) -> DataFrame:
    """Indexes that take more space than their table; one scan sums both kinds of segment."""
    kind = F.when(F.col("segment_type").like("TABLE%"), "T").when(F.col("segment_type").like("INDEX%"), "I")
    sums = segments.withColumn("_kind", kind).filter("_kind IS NOT NULL").groupBy("_kind", "owner", "segment_name").agg(
        F.sum("bytes").alias("bytes")
    )
    tables = sums.filter("_kind = 'T'").select(
        F.col("owner").alias("table_owner"), F.col("segment_name").alias("table_name"), F.col("bytes").alias("t")
    )
    sized = sums.filter("_kind = 'I'").select("owner", F.col("segment_name").alias("index_name"), F.col("bytes").alias("_b"))
    per_index = sized.join(indexes, ["owner", "index_name"]).groupBy(
        "table_owner", "table_name", F.col("owner").alias("index_owner"), "index_name"
    ).agg(F.sum("_b").alias("i"))

    def thousandths(size: Column) -> Column:
        return F.round(size / 1e6, 0) / 1000

    both = tables.filter(F.col("t") > least).join(per_index, ["table_owner", "table_name"]).filter("i > t")
    return both.select(
        "table_owner", "table_name", thousandths(F.col("t")).alias("table_gb"), "index_owner", "index_name",
        thousandths(F.col("i")).alias("index_gb"), thousandths(F.col("i") - F.col("t")).alias("dif_gb"),
        F.round((F.col("i") - F.col("t")) * 100.0 / F.col("t"), 1).alias("dif_perc"),
    ).orderBy("table_owner", "table_name", "index_owner", "index_name")


def stale_statistics(statistics: DataFrame, tables: DataFrame, external: DataFrame, excluded_owners: Sequence[str]) -> DataFrame:
    """Permanent tables whose statistics are out of date."""
    name = F.col("table_name")
    temporary = F.expr("table_name LIKE '%TEMP' OR table_name LIKE '%/_TEMP/_%' ESCAPE '/'")
    stale = statistics.filter(
        (F.col("object_type") == "TABLE") & (F.col("stale_stats") == "YES") & ~name.like("BIN%") & ~temporary
        & ~F.col("owner").isin(list(excluded_owners))
    )
    permanent = tables.filter("temporary = 'N'").select("owner", "table_name")
    key = ["owner", "table_name"]
    return stale.join(permanent, key).join(external, key, "left_anti").select(
        "owner", "table_name", "num_rows", "stattype_locked"
    ).orderBy("owner", "table_name")


def invalid_objects(objects: DataFrame) -> DataFrame:
    return objects.filter("status = 'INVALID'").orderBy("owner", "object_name", "object_id")
