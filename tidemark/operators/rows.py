"""Versioned rows: expiry, tombstones, newest version, replica comparison.

Rows have a key, a replica, a payload, a write time and perhaps times of deletion and expiry.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranking import top_n_per_group
from tidemark.operators.skew import with_neighbour


def _seconds(amount: Column) -> Column:
    return F.make_dt_interval(secs=amount.cast("decimal(18,6)"))


def stamp_ttl(rows: DataFrame, defaults: Mapping[str, int], since: Column, table: str = "table_name") -> DataFrame:
    """Sets ``expires_at``: a row's own ``ttl`` counts first; a table's default only for rows written from ``since`` on."""
    default = F.lit(None).cast("bigint")
    for name, seconds in defaults.items():
        default = F.when(F.col(table) == name, F.lit(seconds)).otherwise(default)
    ttl = F.coalesce(F.col("ttl"), F.when(F.col("write_ts") >= since, default))
    return rows.withColumn("expires_at", F.col("write_ts") + _seconds(ttl))


def expire(rows: DataFrame, as_of: Column) -> DataFrame:
    """Rows that are still valid at ``as_of``."""
    return rows.filter(F.col("expires_at").isNull() | (F.col("expires_at") > as_of))


def backfill_ttl(rows: DataFrame, seconds: int) -> DataFrame:
    """Gives rows without an expiry one, counted from their write time."""
    late = F.col("write_ts") + _seconds(F.lit(seconds))
    return rows.withColumn("expires_at", F.coalesce("expires_at", late))


GC_GRACE = 864000


def purge_tombstones(rows: DataFrame, as_of: Column, grace: int = GC_GRACE) -> DataFrame:
    """Drops tombstones older than the grace period."""
    return rows.filter(F.col("deleted_at").isNull() | (F.col("deleted_at") > as_of - _seconds(F.lit(grace))))


def compact_versions(rows: DataFrame, keys: Sequence[str], as_of: Column, grace: int = GC_GRACE) -> DataFrame:
    """The newest version of every key; a key whose newest version is an old tombstone is gone."""
    # Equal write times: a deletion wins, then the greater payload. Each input task keeps one row per key.
    order = [F.col("write_ts").desc(), F.col("deleted_at").isNotNull().desc(), F.col("payload").desc()]
    newest = top_n_per_group(rows, list(keys), order, 1, "_place").select(*rows.columns)
    return purge_tombstones(newest, as_of, grace)


def _fingerprint() -> Column:
    return F.xxhash64("payload", "write_ts", "deleted_at")


def replica_diff(rows: DataFrame, keys: Sequence[str] = ("key",), replica: str = "replica") -> DataFrame:
    """Keys whose replicas disagree: how many newest versions there are, how many replicas lack the key, and the newest one.

    Only the newest version counts that a replica has of a key; older ones that were not compacted yet make no difference.
    """
    version = F.struct("write_ts", F.col("deleted_at").isNotNull().alias("dead"), "payload", _fingerprint().alias("hash"))
    held = rows.select(*keys, replica, version.alias("_v")).groupBy(*keys, replica).agg(F.max("_v").alias("_v"))
    replicas = rows.select(replica).distinct().agg(F.count("*")).scalar()
    per_key = held.groupBy(*keys).agg(
        F.count_distinct("_v.hash").alias("versions"), F.count("*").alias("_held"), F.max("_v").alias("_n")
    ).withColumn("_replicas", replicas)
    missing = (F.col("_replicas") - F.col("_held")).alias("missing")
    return per_key.filter("versions > 1 OR _held < _replicas").select(
        *keys, "versions", missing, F.col("_n.payload").alias("newest_payload"), F.col("_n.write_ts").alias("newest_write")
    )


def trace_events(lines: DataFrame, session: str, thread: str = "thread") -> DataFrame:
    """The events of one traced session in the order they happened."""
    return lines.filter(F.col(thread) == session).select("line_no", "logged_at", "line").orderBy("logged_at", "line_no")


def pair_durations(lines: DataFrame, start: str, finish: str, chunk: Column | int) -> DataFrame:
    """Start lines with the finish line that follows in the same thread, and the seconds between them.

    ``lines`` has ``thread``, ``line_no``, ``logged_at`` and ``line``.
    """
    kind = F.when(F.col("line").rlike(start), "start").when(F.col("line").rlike(finish), "finish")
    marked = lines.withColumn("kind", kind).filter("kind IS NOT NULL")
    paired = with_neighbour(marked, ["thread"], ["line_no"], ["kind", "logged_at"], chunk, following=True, name="_n")
    done = paired.filter((F.col("kind") == "start") & (F.col("_n.kind") == "finish"))
    micros = F.unix_micros(F.col("_n.logged_at").cast("timestamp")) - F.unix_micros(F.col("logged_at").cast("timestamp"))
    return done.select(
        "thread", "line_no", F.col("logged_at").alias("started"), F.col("_n.logged_at").alias("finished"),
        (micros / F.lit(1e6)).alias("seconds"),
    )
