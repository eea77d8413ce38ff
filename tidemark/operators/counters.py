"""Cumulative counters and snapshot series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import duration_days_hms, guarded_ratio
from tidemark.operators.ranking import top_n_per_group
from tidemark.operators.skew import lookup_join, with_neighbour, with_running_total
from tidemark.specs import LATENCY_BUCKETS, CounterSpec


def counter_delta(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    counters: Sequence[str],
    chunk: Column,
    on_reset: str = "clamp",
    on_new: str = "null",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Replaces each counter by its growth since the row before with the same keys.

    ``on_reset`` says what a fall back becomes: ``clamp`` zero, ``raw`` the negative number, ``null`` nothing.
    ``on_new`` says what the first row of a key becomes: ``full`` its value, ``null`` nothing. Columns in
    ``carry`` are added as ``prev_<name>``.
    """
    paired = with_neighbour(df, keys, order, [*counters, *carry], chunk, name="_p")
    return paired.select(*growth_columns(df.columns, counters, on_reset, on_new), *[F.col(f"_p.{c}").alias(f"prev_{c}") for c in carry])


def growth_columns(columns: Sequence[str], counters: Sequence[str], on_reset: str, on_new: str) -> list[Column]:
    """``columns`` with each counter as its growth since the row before, which stands in a struct ``_p``."""
    if on_reset not in ("clamp", "raw", "null") or on_new not in ("full", "null"):
        raise ValueError("on_reset is clamp, raw or null; on_new is full or null")

    def growth(counter: str) -> Column:
        delta = F.col(counter) - F.col(f"_p.{counter}")
        if on_reset == "clamp":
            delta = F.when(delta < 0, F.lit(0)).otherwise(delta)
        elif on_reset == "null":
            delta = F.when(delta >= 0, delta)
        first = F.col(counter) if on_new == "full" else F.lit(None)
        return F.when(F.col("_p").isNull(), first).otherwise(delta).alias(counter)

    return [growth(c) if c in counters else F.col(c) for c in columns]


def counter_rate(
    df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], counter: str, chunk: Column, **modes: str
) -> DataFrame:
    """Growth per second between neighbouring rows; null when no time has passed."""
    seconds = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col(f"prev_{ts}").cast("timestamp"))) / F.lit(1e6)
    grown = counter_delta(df, keys, order, [counter], chunk, carry=[ts], **modes)
    rate = F.when(seconds > 0, F.col(counter) / seconds)
    return grown.withColumn("elapsed_seconds", seconds).withColumn("rate", rate).drop(f"prev_{ts}")


def with_ratios(df: DataFrame, spec: CounterSpec) -> DataFrame:
    """Adds the ratios of ``spec`` over counter deltas."""
    for ratio in spec.ratios:
        df = df.withColumn(
            ratio.name, guarded_ratio(F.col(ratio.numerator), F.col(ratio.denominator), ratio.scale)
        )
    return df


def spec_report(df: DataFrame, spec: CounterSpec, interval: Sequence[str]) -> DataFrame:
    """Deltas summed up to the shown keys of ``spec`` per interval, with ratios."""
    if spec.shown_keys != spec.keys:
        df = df.groupBy(*interval, *spec.shown_keys).agg(*[F.sum(c).alias(c) for c in spec.counters])
    return with_ratios(df.select(*interval, *spec.shown_keys, *spec.counters), spec)


def latency_bucket(latency: Column) -> Column:
    """The least power of two that is not below the latency, up to the largest bucket; null above that."""
    bounds = F.array(*[F.lit(bound) for bound in LATENCY_BUCKETS])
    return F.get(F.filter(bounds, lambda bound: bound >= latency), F.lit(0)).cast("bigint")


def latency_matrix(df: DataFrame, snap: str = "snap_id") -> DataFrame:
    """Waits per snapshot and power-of-two bucket: columns ``b_1`` to ``b_4194304`` and ``b_over``.

    A latency between two powers counts for the greater one, a null latency nowhere.
    """
    names = [f"b_{bound}" for bound in LATENCY_BUCKETS] + ["b_over"]
    bucket = F.coalesce(F.concat(F.lit("b_"), latency_bucket(F.col("wait_time_milli")).cast("string")), F.lit("b_over"))
    tagged = df.filter("wait_time_milli IS NOT NULL").select(snap, "wait_count", bucket.alias("_bucket"))
    return tagged.groupBy(snap).pivot("_bucket", names).agg(F.sum("wait_count")).na.fill(0, names)


def latency_heatmap(df: DataFrame, snap: str = "snap_id", snaps_per_chunk: int = 1000) -> DataFrame:
    """Growth of every latency bucket from snapshot to snapshot, in long form; a restart counts as zero."""
    bucket = F.coalesce(latency_bucket(F.col("wait_time_milli")), F.lit(2 * LATENCY_BUCKETS[-1]))
    known = df.filter("wait_time_milli IS NOT NULL")
    cells = known.groupBy(bucket.cast("bigint").alias("bucket"), snap).agg(F.sum("wait_count").alias("waits"))
    chunk = F.floor(F.col(snap) / snaps_per_chunk)
    return counter_delta(cells, ["bucket"], [snap], ["waits"], chunk).filter("waits IS NOT NULL")


SERIES = ("dbid", "instance_number")


def last_two_snapshots(df: DataFrame) -> DataFrame:
    """The newest snapshot (``age`` 1) and the one before (``age`` 2) of every database instance."""
    order = [F.col("end_interval_time").desc(), F.col("snap_id").desc()]
    return top_n_per_group(df, SERIES, order, 2, "age")


def snapshot_pairs(df: DataFrame, low: int | None = None, high: int | None = None, per_chunk: int = 1000) -> DataFrame:
    """Neighbouring snapshots of each instance within an id range, as ``(begin_snap, end_snap)``."""
    if low is not None:
        df = df.filter(F.col("snap_id") >= low)
    if high is not None:
        df = df.filter(F.col("snap_id") <= high)
    chunk = F.floor(F.col("snap_id") / per_chunk)
    paired = with_neighbour(df, SERIES, ["snap_id"], ["snap_id"], chunk, following=True, name="_n")
    return paired.filter("_n IS NOT NULL").select(
        *SERIES, F.col("snap_id").alias("begin_snap"), F.col("_n.snap_id").alias("end_snap")
    )


def snapshot_pairs_stride(
    df: DataFrame, stride: int, first_day: Column, last_day: Column, per_chunk: int = 1000
) -> DataFrame:
    """Pairs that lie ``stride`` snapshots apart and follow one another, over whole days of begin time."""
    kept = df.filter(
        (F.col("begin_interval_time") >= first_day)
        & (F.col("begin_interval_time") < last_day + F.expr("INTERVAL '1' DAY"))
    )
    chunk = F.floor(F.col("snap_id") / per_chunk)
    numbered = with_running_total(kept, SERIES, ["snap_id"], F.lit(1), chunk, "_position")
    chosen = numbered.filter((F.col("_position") - 1) % stride == 0).drop("_position")
    return snapshot_pairs(chosen, per_chunk=per_chunk)


def interval_report(
    counters: DataFrame, pairs: DataFrame, keys: Sequence[str], counter: str, n: int
) -> DataFrame:
    """The ``n`` counters that grew most in every snapshot pair. ``counters`` has the pair's instance columns."""
    ends = pairs.select(
        *SERIES, "begin_snap", "end_snap", F.explode(F.array("begin_snap", "end_snap")).alias("snap_id")
    )
    at_ends = lookup_join(counters.select(*SERIES, "snap_id", *keys, counter), ends, [*SERIES, "snap_id"], "inner")
    value = F.col(counter)
    grown = at_ends.groupBy(*SERIES, "begin_snap", "end_snap", *keys).agg(
        (
            F.max(F.when(F.col("snap_id") == F.col("end_snap"), value))
            - F.max(F.when(F.col("snap_id") == F.col("begin_snap"), value))
        ).alias("delta")
    )
    order = [F.col("delta").desc_nulls_last(), *[F.col(k) for k in keys]]
    return top_n_per_group(grown.filter("delta IS NOT NULL"), [*SERIES, "begin_snap"], order, n, "rank")


def snapshot_catalog(df: DataFrame) -> DataFrame:
    """What each database instance has: id range, time range and number of snapshots."""
    return df.groupBy(*SERIES, "db_name", "host_name").agg(
        F.min("snap_id").alias("min_snap"), F.max("snap_id").alias("max_snap"),
        F.min("begin_interval_time").alias("first_begin"), F.max("end_interval_time").alias("last_end"),
        F.count("*").alias("snapshots"),
    )


def gap_extremes(df: DataFrame, start: str, end: str, sequence: str) -> DataFrame:
    """Shortest and longest time from ``start`` to ``end``, without the newest sequence number."""
    newest = df.select(F.max(sequence)).scalar()
    seconds = F.timestamp_diff("SECOND", F.col(start), F.col(end))
    bounds = df.filter(F.col(sequence) != newest).agg(F.min(seconds).alias("low"), F.max(seconds).alias("high"))
    return bounds.select(
        duration_days_hms(F.col("low")).alias("min_interval"), duration_days_hms(F.col("high")).alias("max_interval")
    )
