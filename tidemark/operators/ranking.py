"""Top-N, ranks and per-group leaders.

Filters on ``row_number`` and ``rank`` let Spark keep only the best N of a group in every input task before
the shuffle, so a frequent group does not travel whole to one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def top_n(df: DataFrame, order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows by ``order``, which must end in a unique key; ``rank`` names a position column."""
    best = df.orderBy(*order).limit(n)
    if rank is None:
        return best
    return best.withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def top_n_shown_ascending(df: DataFrame, measure: str, tiebreak: Sequence[str], n: int) -> DataFrame:
    """The ``n`` largest by ``measure``, shown smallest first."""
    best = df.orderBy(F.col(measure).desc(), *[F.col(c).asc() for c in tiebreak]).limit(n)
    return best.orderBy(F.col(measure).asc(), *[F.col(c).desc() for c in tiebreak])


def top_n_per_group(
    df: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int, rank: str = "rn"
) -> DataFrame:
    """The first ``n`` rows of every group by ``order``."""
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return df.withColumn(rank, place).filter(F.col(rank) <= n)


def rank_top(df: DataFrame, order: Column, n: int, rank: str = "rank") -> DataFrame:
    """Rows whose rank by ``order`` is at most ``n``; ties share a rank and all of them stay.

    Ranks come from counts per distinct value, so tied rows never meet in one task.
    """
    counted = df.withColumn("_value", order)
    values = counted.groupBy("_value").agg(F.count("*").alias("_n"))
    # The values that can hold ranks 1..n are the n largest; what follows cannot.
    leaders = values.orderBy(F.col("_value").desc_nulls_last()).limit(n)
    before = Window.orderBy(F.col("_value").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = leaders.withColumn(rank, (F.coalesce(F.sum("_n").over(before), F.lit(0)) + 1).cast("int"))
    ranked = ranked.filter(F.col(rank) <= n).select(F.col("_value").alias("_v"), rank)
    joined = counted.join(F.broadcast(ranked), F.col("_value").eqNullSafe(F.col("_v")))
    return joined.drop("_value", "_v")


def latest_row(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order``: one aggregate with map-side combine, no window."""
    rest = [c for c in df.columns if c not in keys]
    position = F.struct(*[F.col(c) for c in order])
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), position).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)
