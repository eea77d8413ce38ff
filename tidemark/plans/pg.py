"""Health reports over PostgreSQL statistics views landed as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import fmt_bytes
from tidemark.operators import graph
from tidemark.operators.ranking import top_n
from tidemark.operators.skew import lookup_join

SYSTEM_SCHEMAS = ("pg_catalog", "information_schema")


def _age(ts: str, as_of: Column) -> Column:
    """Seconds from ``ts`` to ``as_of``."""
    return (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / F.lit(1e6)


def database_sizes(relations: DataFrame, database: str, size: str) -> DataFrame:
    sums = relations.groupBy(F.col(database).alias("database_name")).agg(F.sum(size).alias("bytes"))
    return sums.withColumn("size", fmt_bytes(F.col("bytes"))).orderBy(F.col("bytes").desc(), "database_name")


def sessions_by_state(activity: DataFrame, own_pid: int) -> DataFrame:
    others = activity.filter(F.col("pid") != own_pid)
    return others.groupBy("state", "usename").agg(F.count("*").alias("n")).orderBy("usename", "state")


# What identifies a lock, apart from who holds it.
LOCK_IDENTITY = (
    "locktype", "database", "relation", "page", "tuple", "virtualxid", "transactionid", "classid", "objid", "objsubid",
)


def blocking(locks: DataFrame, activity: DataFrame, as_of: Column, identity: Sequence[str]) -> DataFrame:
    """Blocked sessions with a session that blocks them, both statements and how long both have run."""
    found = graph.blocked_by(locks, identity, "pid", "granted", "NOT granted", ["pid"])

    def side(name: str) -> DataFrame:
        return activity.select(
            F.col("pid").alias(f"{name}_pid"), F.col("usename").alias(f"{name}_user"),
            F.col("query").alias(f"{name}_statement"), _age("query_start", as_of).alias(f"{name}_duration"),
        )

    pairs = found.select(
        *identity, F.col("waiter").alias("blocked_pid"), F.col("blocker").alias("blocking_pid"), "n_blockers"
    )
    named = lookup_join(pairs, side("blocked"), ["blocked_pid"], "inner")
    return lookup_join(named, side("blocking"), ["blocking_pid"], "inner")


def blocking_by_transaction(locks: DataFrame, activity: DataFrame, as_of: Column) -> DataFrame:
    # Locks without a transaction id never meet.
    return blocking(locks.filter("transactionid IS NOT NULL"), activity, as_of, ["transactionid"])


def blocking_by_identity(locks: DataFrame, activity: DataFrame, as_of: Column) -> DataFrame:
    return blocking(locks, activity, as_of, LOCK_IDENTITY)


def dead_rows(tables: DataFrame, columns: Sequence[str], n: int) -> DataFrame:
    """Tables with most dead rows."""
    return top_n(tables.select(*columns), [F.col("n_dead_tup").desc(), F.col("relname")], n)


def maintenance_running(activity: DataFrame, as_of: Column, least_seconds: int = 0) -> DataFrame:
    """Maintenance workers and their run time."""
    workers = activity.filter(F.col("query").like("autovacuum:%"))
    aged = workers.select("pid", "query", "state", _age("xact_start", as_of).alias("duration"), _age("query_start", as_of).alias("_q"))
    if least_seconds:
        aged = aged.filter((F.col("state") == "active") & (F.col("_q") > least_seconds))
    return aged.drop("_q").orderBy(F.col("duration").desc(), "pid")


def running_statements(activity: DataFrame, as_of: Column, least_seconds: float = 1) -> DataFrame:
    kept = activity.filter(
        ~F.col("state").isin("idle", "idle in transaction") & ~F.col("query").like("autovacuum:%")
    )
    aged = kept.select("pid", _age("query_start", as_of).alias("duration"), "query", "state")
    return aged.filter(F.col("duration") > least_seconds).orderBy(F.col("duration").desc(), "pid")


def connections_by_state(activity: DataFrame) -> DataFrame:
    return activity.groupBy("state").agg(F.count("*").alias("n"))


def maintenance_times(tables: DataFrame) -> DataFrame:
    return tables.select("relname", "last_vacuum", "last_analyze")


def _user_relations(classes: DataFrame, namespaces: DataFrame) -> DataFrame:
    spaces = namespaces.withColumnRenamed("oid", "relnamespace")
    named = lookup_join(classes, spaces, ["relnamespace"])
    return named.filter(~F.col("nspname").isin(*SYSTEM_SCHEMAS))


def largest_relations(classes: DataFrame, namespaces: DataFrame, n: int = 20) -> DataFrame:
    rows = _user_relations(classes, namespaces).select("nspname", "relname", F.col("table_bytes").alias("bytes"))
    best = top_n(rows, [F.col("bytes").desc(), F.col("relname")], n)
    return best.withColumn("size", fmt_bytes(F.col("bytes")))


def largest_with_indexes(classes: DataFrame, namespaces: DataFrame, n: int = 20) -> DataFrame:
    """Largest tables and indexes with their table, index and total size."""
    rows = _user_relations(classes, namespaces).filter(
        ~F.col("nspname").rlike("^pg_toast") & F.col("relkind").isin("r", "i")
    ).withColumn("total_bytes", F.col("table_bytes") + F.col("index_bytes"))
    best = top_n(rows, [F.col("total_bytes").desc(), F.col("relname")], n)
    return best.select(
        "nspname", "relname", "relkind", fmt_bytes(F.col("table_bytes")).alias("size"),
        fmt_bytes(F.col("index_bytes")).alias("idxsize"), fmt_bytes(F.col("total_bytes")).alias("total"), "total_bytes",
    )


def temp_files(samples: DataFrame) -> DataFrame:
    """Temporary files and bytes per database instance."""
    return samples.groupBy("inst_id").agg(
        F.count_if(F.col("temp_space_allocated") > 0).alias("temp_files"), F.sum("temp_space_allocated").alias("temp_bytes")
    )


def index_use(tables: DataFrame) -> DataFrame:
    scans = F.col("seq_scan") + F.col("idx_scan")
    pct = F.when(scans != 0, F.lit(100.0) * F.col("idx_scan") / scans).otherwise(F.lit(0.0))
    return tables.select("relname", pct.alias("pct_index_used"), F.col("n_live_tup").alias("rows_in_table")).orderBy(
        F.col("rows_in_table").desc(), "relname"
    )


def largest_keyed_tables(classes: DataFrame, namespaces: DataFrame, keyed: DataFrame, n: int = 25) -> DataFrame:
    """Largest tables that have a primary key; ``keyed`` holds their names."""
    rows = _user_relations(classes, namespaces).filter(
        ~F.col("nspname").rlike("^pg_toast") & ~F.expr("nspname LIKE '/_edb%' ESCAPE '/'")
    )
    with_key = rows.join(keyed.select("relname").distinct(), "relname", "left_semi")
    sized = with_key.select("nspname", "relname", (F.col("table_bytes") + F.col("index_bytes")).alias("total_bytes"))
    best = top_n(sized, [F.col("total_bytes").desc(), F.col("relname")], n)
    return best.withColumn("total_size", fmt_bytes(F.col("total_bytes")))


def _pages_needed(rows: Column, row_bytes: Column, block: int) -> Column:
    """Pages that so many rows would fill without gaps; each page has a header of 20 bytes."""
    return F.ceil(rows * row_bytes / F.lit(float(block - 20)))


def bloat(
    stats: DataFrame, classes: DataFrame, namespaces: DataFrame, indexes: DataFrame, block: int = 8192, align: int = 4,
    header: int = 23, n: int = 25,
) -> DataFrame:
    """Estimated waste in tables and their indexes; ``stats`` has ``null_frac`` and ``avg_width`` per column.

    A row takes its mean column widths and its header, both filled up to the alignment, a null map if a column can be
    null, and a pointer of 4 bytes. An index entry goes without 12 bytes of the row header. What a relation has
    beyond the pages its rows need counts as waste.
    """
    def aligned(size: Column) -> Column:
        return F.ceil(size / align) * align

    columns = stats.groupBy("schemaname", "tablename").agg(
        F.sum((1 - F.col("null_frac")) * F.col("avg_width")).alias("width"), F.max("null_frac").alias("null_share"),
        F.count_if(F.col("null_frac") != 0).alias("nullable"),
    )
    null_map = F.col("null_share") * aligned(F.lit(header) + 1 + F.floor(F.col("nullable") / 8))
    # A part that is aligned already is not filled up, but for the header, which always is.
    shape = columns.select(
        "schemaname", "tablename", (F.col("width") + (header + align - header % align)).alias("bare_row"), null_map.alias("null_map")
    )
    spaces = namespaces.filter("nspname <> 'information_schema'").select(
        F.col("oid").alias("relnamespace"), F.col("nspname").alias("schemaname")
    )
    tables = lookup_join(classes, spaces, ["relnamespace"], "inner").select(
        F.col("oid").alias("indrelid"), "schemaname", F.col("relname").alias("tablename"), "reltuples", "relpages"
    )
    own = classes.select(
        F.col("oid").alias("indexrelid"), F.col("relname").alias("index_name"), F.col("reltuples").alias("entries"),
        F.col("relpages").alias("index_pages"),
    )
    both = shape.join(tables, ["schemaname", "tablename"]).join(indexes.join(own, "indexrelid").drop("indexrelid"), "indrelid", "left")
    full_row = aligned(F.col("bare_row")) + F.col("null_map") + 4
    needs = both.select(
        "schemaname", "tablename", F.col("relpages").alias("has"), _pages_needed(F.col("reltuples"), full_row, block).alias("needs"),
        F.coalesce("index_name", F.lit("?")).alias("iname"), F.coalesce("index_pages", F.lit(0)).alias("index_has"),
        F.coalesce(_pages_needed(F.col("entries"), F.col("bare_row") - 12, block), F.lit(0)).alias("index_needs"),
    )

    def times(has: str, wanted: str) -> Column:
        return F.round(F.col(has) / F.when(F.col(wanted) != 0, F.col(wanted)), 1)

    def waste(has: str, wanted: str) -> Column:
        return F.greatest(F.lit(0.0), F.lit(block) * (F.col(has) - F.col(wanted)) / 1024 / 1024)

    out = needs.select(
        "schemaname", "tablename", F.coalesce(times("has", "needs"), F.lit(0.0)).alias("tbloat"),
        F.round(waste("has", "needs"), 0).cast("bigint").alias("wasted_mb"), "iname",
        F.coalesce(times("index_has", "index_needs"), F.lit(0.0)).alias("ibloat"), waste("index_has", "index_needs").alias("wasted_index_mb"),
    )
    return top_n(out, [F.col("wasted_mb").desc(), F.col("tablename"), F.col("iname")], n)


def long_sessions(activity: DataFrame, as_of: Column, least_seconds: int, state: str | None = None) -> DataFrame:
    """Sessions whose statement began more than ``least_seconds`` ago, of one state or of all."""
    aged = activity.withColumn("duration", _age("query_start", as_of)).filter(F.col("duration") > least_seconds)
    if state is not None:
        aged = aged.filter((F.col("state") == state) & ~F.col("query").like("autovacuum%"))
    return aged.select("pid", "usename", "client_addr", "duration", "query", "state").orderBy(F.col("duration").desc(), "pid")
