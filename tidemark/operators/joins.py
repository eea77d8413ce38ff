"""Joins with a rule of their own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.skew import lookup_join, with_neighbour


def left_prefiltered(left: DataFrame, right: DataFrame, on: Sequence[str], keep: Column) -> DataFrame:
    """Left join with a condition on the optional side; it is applied before the join and loses no left row."""
    return lookup_join(left, right.filter(keep), list(on))


def any_one(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """One value per key. The least is taken so that every run picks the same."""
    return df.groupBy(*keys).agg(F.min(column).alias(column))


def threshold_fallback(
    facts: DataFrame, thresholds: DataFrame, target: str, key: str, limits: Sequence[str]
) -> DataFrame:
    """Adds the limits set for ``(target, key)``, or else those of the target's row with a blank key."""
    clean = thresholds.select(
        target, F.trim(F.coalesce(F.col(key), F.lit(""))).alias(key), *[F.col(c).cast("string").try_cast("double") for c in limits]
    )
    own = clean.filter(F.col(key) != "").groupBy(target, key).agg(
        *[F.max(c).alias(f"_own_{c}") for c in limits]
    )
    default = clean.filter(F.col(key) == "").groupBy(target).agg(
        *[F.max(c).alias(f"_default_{c}") for c in limits]
    )
    joined = lookup_join(lookup_join(facts, own, [target, key]), default, [target])
    found = [F.coalesce(f"_own_{c}", f"_default_{c}").alias(c) for c in limits]
    return joined.select(*facts.columns, *found)


def path_prefixes(path: Column) -> Column:
    """Every leading part of an absolute path that ends at a slash border, the path itself included."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    steps = F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts))).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")))


def longest_prefix(
    paths: DataFrame, mounts: DataFrame, path_id: Sequence[str], path: str, mount: str, on: Sequence[str] = ()
) -> DataFrame:
    """The longest mount point that contains each path, by equality on exploded path prefixes.

    Paths without a mount are left out. ``on`` are columns, such as a host, that must agree as well.
    """
    unique = mounts.select(*on, F.col(mount).alias("_prefix")).distinct()
    steps = paths.select(*path_id, *on, path, F.explode(path_prefixes(F.col(path))).alias("_prefix"))
    found = lookup_join(steps, unique, [*on, "_prefix"], "inner")
    best = F.max_by("_prefix", F.length("_prefix")).alias(mount)
    return found.groupBy(*path_id, *on, path).agg(best)


def full_reconcile(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Every key of either side once, with ``in_left`` and ``in_right``."""
    a = left.select(*on).distinct().withColumn("in_left", F.lit(True))
    b = right.select(*on).distinct().withColumn("in_right", F.lit(True))
    joined = a.join(b, list(on), "full")
    return joined.select(
        *on, F.coalesce("in_left", F.lit(False)).alias("in_left"),
        F.coalesce("in_right", F.lit(False)).alias("in_right"),
    )


def symmetric_difference(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys found on one side only, and on which; copies within a side count once."""
    both = full_reconcile(left, right, on).filter(F.col("in_left") != F.col("in_right"))
    return both.select(*on, F.when(F.col("in_left"), "right").otherwise("left").alias("missing_in"))


def unique_in_order(df: DataFrame, columns: Sequence[str], position: str, name: str = "first_position") -> DataFrame:
    """The distinct values of ``columns`` in the order they are first seen, with the position of the first."""
    return df.groupBy(*columns).agg(F.min(position).alias(name)).orderBy(name, *columns)


def previous_line(lines: DataFrame, chunk_lines: int = 10000) -> DataFrame:
    """Adds the text of the line before, within each file; long files are worked on in stretches of lines."""
    chunk = F.floor(F.col("line_no") / chunk_lines)
    paired = with_neighbour(lines, ["node", "file"], ["line_no"], ["line"], chunk)
    return paired.withColumn("previous_line", F.col("previous.line")).drop("previous")


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join in which two nulls agree; the result has the columns of ``left`` and the rest of ``right``."""
    renamed = right.select(
        *[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns]
    )
    condition = F.lit(True)
    for c in on:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(renamed, condition, how).drop(*[f"_r_{c}" for c in on])
