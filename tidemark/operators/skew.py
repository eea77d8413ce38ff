"""Building blocks that keep one very frequent key from landing in a single task.

Neighbour and running-total operators work in two steps. Rows are first windowed inside
``(key, chunk)``, where ``chunk`` is a stretch of the ordering column (an hour, a thousand lines), so a
frequent key is spread over as many tasks as it has chunks. One summary row per ``(key, chunk)``
carries values across chunk borders. The result equals the plain window over the key for any chunk size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def stretch(position: str, width: int) -> Column:
    """The stretch of ``width`` positions that a whole-number or time column (in seconds) falls in."""
    return F.floor(F.col(position).cast("double") / width)


def _chunked(df: DataFrame, order: Sequence[str], chunk: Column | int) -> DataFrame:
    if isinstance(chunk, Column):
        return df.withColumn("_chunk", chunk)
    if dict(df.dtypes)[order[0]] == "timestamp_ntz":
        return df.withColumn("_chunk", F.floor(F.unix_micros(F.col(order[0]).cast("timestamp")) / (chunk * 1_000_000)))
    return df.withColumn("_chunk", stretch(order[0], chunk))


def _in_step(edges: DataFrame, keys: Sequence[str], value: Column) -> Column:
    """``value``, or an error where a stretch begins before the one ahead of it ends."""
    ahead = F.lag("_high").over(Window.partitionBy(*keys).orderBy("_chunk"))
    return F.when(ahead > F.col("_low"), F.raise_error(F.lit("chunk decreases along the order"))).otherwise(value)


def _border_rows(df: DataFrame, keys: Sequence[str], borders: DataFrame, place: int, values: str) -> DataFrame:
    """Border values as rows of their own: keys, stretch and values, nothing else."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    columns = [F.col(c) if c in keys else F.lit(None).cast(kinds[c]).alias(c) for c in df.columns]
    return borders.select(*columns, "_chunk", F.lit(place).alias("_place"), F.col(values).alias("_value"))


def with_neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    chunk: Column | int,
    *,
    following: bool = False,
    name: str = "previous",
) -> DataFrame:
    """Adds a struct ``name`` with ``columns`` of the row before (or after) within ``keys`` by ``order``.

    The struct is null for the first (or last) row of a key. ``chunk`` is a width in positions of the first order
    column, or an expression that must not decrease along ``order``; one that does is an error. The rows are shuffled
    once: the edges of the stretches are aggregated, and each carried edge joins the rows of its stretch as one more row.
    """
    chunked = _chunked(df, order, chunk)
    across = Window.partitionBy(*keys).orderBy("_chunk")
    step = F.lead if following else F.lag
    edge = F.min_by if following else F.max_by
    # One value per column rather than one struct: numbers then aggregate by hash, without a sort.
    position = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    edges = chunked.groupBy(*keys, "_chunk").agg(
        *[edge(c, position).alias(f"_e_{c}") for c in columns], F.min(order[0]).alias("_low"), F.max(order[0]).alias("_high")
    )
    edge_row = F.struct(*[F.col(f"_e_{c}").alias(c) for c in columns])
    borders = edges.select(*keys, "_chunk", _in_step(edges, keys, step(edge_row).over(across)).alias("_carried"))
    rows = chunked.select(*df.columns, "_chunk", F.lit(1).alias("_place"), F.struct(*columns).alias("_value"))
    both = rows.unionByName(_border_rows(df, keys, borders, 2 if following else 0, "_carried"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy("_place", *order)
    return both.withColumn(name, step("_value").over(inside)).filter("_place = 1").select(*df.columns, name)


def with_running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    amount: Column,
    chunk: Column | int,
    name: str = "running",
) -> DataFrame:
    """Adds the sum of ``amount`` over the rows of the key up to and including each row.

    ``chunk`` is as for :func:`with_neighbour`, and so is the plan: the total before a stretch is one more row of it.
    """
    chunked = _chunked(df, order, chunk).withColumn("_value", F.coalesce(amount, F.lit(0)))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    edges = chunked.groupBy(*keys, "_chunk").agg(
        F.sum("_value").alias("_total"), F.min(order[0]).alias("_low"), F.max(order[0]).alias("_high")
    )
    offset = F.coalesce(F.sum("_total").over(before), F.lit(0))
    borders = edges.select(*keys, "_chunk", _in_step(edges, keys, offset).alias("_offset"))
    rows = chunked.select(*df.columns, "_chunk", F.lit(1).alias("_place"), "_value")
    both = rows.unionByName(_border_rows(df, keys, borders, 0, "_offset"))
    inside = (
        Window.partitionBy(*keys, "_chunk").orderBy("_place", *order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return both.withColumn(name, F.sum("_value").over(inside)).filter("_place = 1").select(*df.columns, name)


#: A key with more rows than this is dealt over several tasks by :func:`lookup_join`.
HOT_ROWS = 1_000_000
#: Tables of fewer bytes than this have no key that is too large for a task.
HOT_BYTES = 256 << 20
#: Frequent keys that are dealt, the most frequent first, and bytes of a table whose keys are counted; of a larger one a sample is.
MOST_HOT, COUNTED_BYTES = 1_000, 8 << 30
#: What Spark takes for the size of a table it knows nothing of, or more.
_UNKNOWN = 1 << 62


def leaf_bytes(df: DataFrame) -> int:
    """Bytes of the tables that ``df`` is made of, by what Spark knows of them without a job."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))


def hot_hashes(df: DataFrame, on: Sequence[str], hot_rows: int) -> dict[int, int]:
    """Hashes of the keys that have more rows than ``hot_rows``, at most ``MOST_HOT``, with the number of parts to deal them into.

    Keys are counted with map-side combine, in a table of more than ``COUNTED_BYTES`` those of a sample of that size: what is
    shuffled is bounded, and goes to many tasks. A key that is missed for that is joined as it is. Nulls count as well.
    """
    size = leaf_bytes(df)
    share = 1.0 if size >= _UNKNOWN else min(1.0, COUNTED_BYTES / max(size, 1))
    hashes = df.select(F.xxhash64(*[F.col(c) for c in on]).alias("h"))
    counted = (hashes if share == 1 else hashes.sample(share, seed=0)).groupBy("h").agg(F.count("*").alias("n"))
    most = counted.filter(F.col("n") > hot_rows * share).orderBy(F.desc("n"), "h").limit(MOST_HOT).collect()
    return {row["h"]: math.ceil(row["n"] / share / hot_rows) for row in most}


def _parts(on: Sequence[str], hot: dict[int, int]) -> Column:
    """The number of parts of the row's key: 1 for all but the hot ones."""
    if not hot:
        return F.lit(1)
    known = F.create_map(*[F.lit(v) for pair in hot.items() for v in pair])
    return F.coalesce(F.try_element_at(known, F.xxhash64(*[F.col(c) for c in on])), F.lit(1)).cast("int")


def _row_number(df: DataFrame) -> Column:
    """A number from the row's values and its input partition, so that a task run again deals its rows as before."""
    plain = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(*[F.col(f"`{c}`") for c in plain]) + F.spark_partition_id()


def lookup_join(
    facts: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "left", null_safe: bool = False,
    hot_rows: int = HOT_ROWS, hot_bytes: int = HOT_BYTES,
) -> DataFrame:
    """Joins ``facts`` to ``lookup``; a frequent key of either side is dealt over as many tasks as its rows need.

    Frequent keys are found by a count, of a bounded sample at most, over each side that is larger than ``hot_bytes``. Only they are dealt, into one
    part for each ``hot_rows`` rows, and only their rows of the other side are copied, once to each part. All other rows are
    joined as they are. In a left join rows with a null in the key, which match nothing, are dealt by their other values; with
    ``null_safe`` two nulls agree. Smaller tables are joined plainly.
    """
    if how not in ("left", "inner"):
        raise ValueError("lookup_join is for left and inner joins")
    on = list(on)
    hot_facts, hot_lookup = (hot_hashes(df, on, hot_rows) if leaf_bytes(df) >= hot_bytes else {} for df in (facts, lookup))
    if hot_lookup and how == "left":
        # A key that is frequent in the lookup has a match, so its rows may be joined as in an inner join.
        dealt = F.coalesce(F.array_contains(F.array(*[F.lit(h) for h in hot_lookup]), F.xxhash64(*[F.col(c) for c in on])), F.lit(False))
        there = reduce(Column.__and__, [F.col(c).isNotNull() for c in on]) if not null_safe else F.lit(True)
        rest = _dealt(facts.filter(~(dealt & there)), lookup, on, "left", null_safe, hot_facts, {})
        return _dealt(facts.filter(dealt & there), lookup, on, "inner", null_safe, hot_facts, hot_lookup).unionByName(rest)
    return _dealt(facts, lookup, on, how, null_safe, hot_facts, hot_lookup)


def _dealt(
    facts: DataFrame, lookup: DataFrame, on: list[str], how: str, null_safe: bool, hot_facts: dict[int, int], hot_lookup: dict[int, int]
) -> DataFrame:
    salts: list[str] = []
    if hot_facts:
        part = F.pmod(_row_number(facts), _parts(on, hot_facts)).cast("int")
        if how == "left" and not null_safe:
            none = reduce(Column.__or__, [F.col(c).isNull() for c in on])
            part = F.when(none, -1 - F.pmod(_row_number(facts), F.lit(1 << 30)).cast("int")).otherwise(part)
        facts = facts.withColumn("_part", part)
        lookup = lookup.withColumn("_part", F.explode(F.sequence(F.lit(0), _parts(on, hot_facts) - 1)))
        salts.append("_part")
    if hot_lookup:
        facts = facts.withColumn("_piece", F.explode(F.sequence(F.lit(0), _parts(on, hot_lookup) - 1)))
        lookup = lookup.withColumn("_piece", F.pmod(_row_number(lookup), _parts(on, hot_lookup)).cast("int"))
        salts.append("_piece")
    if not null_safe:
        return facts.join(lookup, [*on, *salts], how).drop(*salts)
    names = {c: f"_on_{k}" for k, c in enumerate([*on, *salts])}
    copies = lookup.withColumnsRenamed(names)
    condition = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(renamed)) for c, renamed in names.items()])
    return facts.join(copies, condition, how).drop(*salts, *names.values())


#: Bytes of a table that may be sent to every executor.
MOST_SENT_BYTES = 64 << 20


def bounded(df: DataFrame, row_bytes: int, most: int = MOST_SENT_BYTES) -> DataFrame:
    """``df``, a written table, marked for broadcast if its rows are few enough; else as it is, for Spark to choose."""
    return F.broadcast(df) if df.count() * row_bytes <= most else df


def semi_lookup(facts: DataFrame, wanted: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``facts`` whose key is in ``wanted``; keys are made distinct before they travel."""
    return lookup_join(facts, wanted.select(*on).distinct(), on, "inner").select(*facts.columns)
