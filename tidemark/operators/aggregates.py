"""Aggregations beyond a plain ``groupBy``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.skew import with_running_total


def distinct_counts(
    df: DataFrame, groups: Sequence[str], columns: Sequence[str], error: float | None = None
) -> DataFrame:
    """Distinct values of each column per group: exact, or within the relative ``error`` by a sketch of fixed size."""
    counts = [
        F.count_distinct(c).alias(c) if error is None else F.approx_count_distinct(c, error).alias(c) for c in columns
    ]
    return df.groupBy(*groups).agg(*counts)


def percent_of_total(df: DataFrame, measure: str, name: str = "pct", digits: int = 2) -> DataFrame:
    """Adds the share of ``measure`` in its grand total; the total is one scalar, not a window over all rows."""
    total = df.select(F.sum(measure)).scalar()
    share = F.col(measure).cast("double") * 100 / F.nullif(total.cast("double"), F.lit(0.0))
    return df.withColumn(name, F.round(share, digits))


def with_totals(df: DataFrame, groups: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Sums per group with subtotals and a grand total; ``total_level`` is 0 for plain groups."""
    out = df.rollup(*groups).agg(
        F.grouping_id(*groups).cast("int").alias("total_level"), *[F.sum(c).alias(c) for c in sums]
    )
    return out


def hourly_volume(df: DataFrame, groups: Sequence[str], ts: str) -> DataFrame:
    """Rows per day and hour of day: ``h00`` to ``h23`` and their total."""
    hours = list(range(24))
    tagged = df.select(*groups, F.to_date(ts).alias("_day"), F.hour(ts).alias("_hour"))
    counts = tagged.groupBy(*groups, "_day").pivot("_hour", hours).agg(F.count(F.lit(1)))
    shown = [F.coalesce(F.col(str(h)), F.lit(0)).alias(f"h{h:02d}") for h in hours]
    out = counts.select(*groups, F.col("_day").cast("string").alias("log_date"), *shown)
    return out.withColumn("total", sum((F.col(f"h{h:02d}") for h in hours[1:]), F.col("h00")))


def worst_age(df: DataFrame, keys: Sequence[str], ts: str, as_of: Column, name: str = "worst_days") -> DataFrame:
    """The greatest age in whole days among the newest rows of all keys."""
    newest = df.groupBy(*keys).agg(F.max(ts).alias("_newest"))
    age = F.timestamp_diff("SECOND", F.col("_newest"), as_of) / F.lit(86400.0)
    return newest.agg(F.max(F.round(age, 0)).cast("bigint").alias(name))


def member_list(
    df: DataFrame, keys: Sequence[str], member: str, name: str = "members", page_size: int | None = None, prefix: int = 3
) -> DataFrame:
    """Distinct members of each key, sorted and joined by commas.

    One list is one value, so without ``page_size`` the members must come from a domain of limited size. With it
    there is one list for every so many members in their order, numbered by ``page`` from 0; members are counted in
    stretches that share their first ``prefix`` characters.
    """
    groups = list(keys)
    distinct = df.select(*groups, F.col(member).cast("string").alias(member)).distinct()
    if page_size is not None:
        distinct = distinct.filter(F.col(member).isNotNull())
        place = with_running_total(distinct, groups, [member], F.lit(1), F.substring(member, 1, prefix), "_number")
        distinct = place.withColumn("page", F.floor((F.col("_number") - 1) / page_size)).drop("_number")
        groups.append("page")
    return distinct.groupBy(*groups).agg(F.array_join(F.array_sort(F.collect_list(member)), ",").alias(name))


def roll_up_key(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Sums of ``measures`` after the other key parts are dropped."""
    return df.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])
