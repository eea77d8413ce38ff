"""Daily sketches that are kept as a table and merged over any range of days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the register number of a distinct-count sketch, and size of a quantile sketch.
REGISTER_BITS, QUANTILE_SIZE = 12, 400
#: Standard error of a distinct count, and error of a rank that 99 of 100 estimates keep.
DISTINCT_ERROR, RANK_ERROR = 1.04 / 2 ** (REGISTER_BITS / 2), 0.01


def daily_sketches(rows: DataFrame, day: Column, keys: Sequence[str], who: str, measure: str) -> DataFrame:
    """(day, keys, rows, distinct, spread): per day and key the number of rows, a sketch of the distinct ``who`` and one of ``measure``.

    A day's rows are read once; what is kept of them is a few kilobytes per key. Null ``who`` and ``measure`` are in no sketch.
    """
    return rows.withColumn("day", day).groupBy("day", *keys).agg(
        F.count("*").alias("rows"), F.hll_sketch_agg(who, REGISTER_BITS).alias("distinct"),
        F.kll_sketch_agg_double(F.col(measure).cast("double"), QUANTILE_SIZE).alias("spread"),
    )


def rolled_up(sketches: DataFrame, keys: Sequence[str], first: Column, last: Column, shares: Sequence[float] = (0.5, 0.95)) -> DataFrame:
    """(keys, rows, distinct, p…): estimates over the days from ``first`` to ``last`` from the sketches alone.

    The distinct count has a standard error of ``DISTINCT_ERROR``; the value given for a share has a rank that is off by no
    more than ``RANK_ERROR`` in 99 of 100 cases, or is null where no value was seen. Any days can be merged, in any order.
    """
    merged = sketches.filter(F.col("day").between(first, last)).groupBy(*keys).agg(
        F.sum("rows").alias("rows"), F.hll_union_agg("distinct").alias("_d"), F.kll_merge_agg_double("spread").alias("_s")
    )
    seen = F.kll_sketch_get_n_double("_s") > 0
    values = [F.when(seen, F.kll_sketch_get_quantile_double("_s", F.lit(share))).alias(f"p{round(share * 100)}") for share in shares]
    return merged.select(*keys, "rows", F.hll_sketch_estimate("_d").alias("distinct"), *values)
