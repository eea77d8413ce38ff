"""Counter series laid out so that growth is found without shuffling them.

A series is landed once, bucketed by its key and by stretches of its position, so that a frequent key is spread over buckets too.
Afterwards the neighbour of a row stands in its own bucket, but for the first row of a stretch; only one row per key and
stretch is shuffled to bring that one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.counters import growth_columns
from tidemark.operators.skew import stretch

_PLACE = ("_slot", "_stretch")


def land_series(df: DataFrame, table: str, folder: str, keys: Sequence[str], position: str, width: int, buckets: int) -> None:
    """Writes ``df`` as a table of Parquet files in ``folder``, one file for each bucket.

    ``position`` is a whole number or a time (in seconds) that orders the rows of a key; ``width`` positions make a stretch. Null keys
    are keys like others; a null position is an error, as the row has no place in its series.
    """
    place = F.when(F.col(position).isNull(), F.raise_error(F.lit("a row without a position"))).otherwise(stretch(position, width))
    placed = df.withColumn("_slot", F.xxhash64(*[F.col(k) for k in keys])).withColumn("_stretch", place.cast("bigint"))
    sorted_ = placed.repartition(buckets, *_PLACE).sortWithinPartitions(*_PLACE, *keys, position)
    sorted_.write.mode("overwrite").bucketBy(buckets, *_PLACE).sortBy(*_PLACE, position).option("path", folder).saveAsTable(table, format="parquet")


def series_delta(
    spark: SparkSession, table: str, keys: Sequence[str], position: str, counters: Sequence[str], on_reset: str = "clamp", on_new: str = "null"
) -> DataFrame:
    """As ``counter_delta`` with the order ``position``, over a table that :func:`land_series` wrote; its rows are not shuffled."""
    rows = spark.table(table)
    order = F.col(position)
    inside = Window.partitionBy(*_PLACE, *keys).orderBy(position)
    value = F.struct(*[F.col(c) for c in counters])
    edges = rows.groupBy(*_PLACE, *keys).agg(*[F.max_by(c, order).alias(c) for c in counters])
    across = Window.partitionBy("_slot", *keys).orderBy("_stretch")
    carried = edges.select(*_PLACE, *[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], F.lag(value).over(across).alias("_carried"))
    # The hash of the key and the stretch are never null, so that the join can use the buckets; the keys are compared afterwards.
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)])
    within = rows.withColumn("_before", F.lag(value).over(inside)).withColumn("_first", F.row_number().over(inside) == 1)
    paired = within.join(carried, list(_PLACE)).filter(same).withColumn("_p", F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_before")))
    kept = [c for c in rows.columns if c not in _PLACE]
    return paired.select(*growth_columns(kept, counters, on_reset, on_new))
