"""Copies of a table compared by digests of key ranges, so that ranges that are equal cost one row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.skew import bounded
from tidemark.session import written

#: Levels of the tree and bits of the key's hash that each adds: the least ranges are told apart by their product.
LEVELS, BITS = 4, 5


def _hash(columns: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(c) for c in columns])


def _range(keys: Sequence[str], bits: int) -> Column:
    """The first bits of the key's hash as a number."""
    return F.shiftrightunsigned(_hash(keys), 64 - bits)


def range_digests(rows: DataFrame, keys: Sequence[str], values: Sequence[str], levels: int = LEVELS, bits: int = BITS) -> DataFrame:
    """(level, range, rows, total, mixed): the number of rows, the sum and the exclusive or of their hashes in every range.

    A range of level n is all keys whose hash begins with the same ``n * bits`` bits; the digests do not depend on the order of
    the rows, so a range is digested by every task that has rows of it and the parts are combined. The rows are read
    once, for the lowest level; a level above is made of the one below. Repeated rows count as often as they stand there.
    """
    if levels * bits > 62:
        raise ValueError("a range is told by at most 62 bits")
    own = F.xxhash64(*[F.col(c) for c in (*keys, *values)])
    lowest = rows.select(_range(keys, levels * bits).alias("range"), own.alias("_h")).groupBy("range").agg(
        F.count("*").alias("rows"), F.sum(F.col("_h").cast("decimal(20,0)")).alias("total"), F.bit_xor("_h").alias("mixed")
    )
    found = [written(lowest.select(F.lit(levels).alias("level"), "range", "rows", F.col("total").cast("decimal(38,0)").alias("total"), "mixed"), "digests")]
    for level in range(levels - 1, 0, -1):
        above = found[-1].groupBy(F.shiftright("range", bits).alias("range")).agg(
            F.sum("rows").alias("rows"), F.sum("total").cast("decimal(38,0)").alias("total"), F.bit_xor("mixed").alias("mixed")
        )
        found.append(above.select(F.lit(level).alias("level"), "range", "rows", "total", "mixed"))
    return reduce(DataFrame.unionByName, found)


def differing_ranges(one: DataFrame, other: DataFrame, levels: int = LEVELS, bits: int = BITS) -> DataFrame:
    """(range): the lowest ranges that differ, by two tables of digests; only below a range that differs the next are compared."""
    below = None
    for level in range(1, levels + 1):
        mine, theirs = (df.filter(F.col("level") == level).drop("level") for df in (one, other))
        if below is not None:
            wanted = below.select(F.col("range").alias("_above"))
            mine, theirs = (df.join(wanted, F.shiftright("range", bits) == F.col("_above"), "left_semi") for df in (mine, theirs))
        theirs = theirs.select("range", *[F.col(c).alias(f"_{c}") for c in ("rows", "total", "mixed")])
        equal = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("rows", "total", "mixed")])
        below = written(mine.join(theirs, "range", "full").filter(~equal).select("range"), "ranges")
    return below


def range_diff(
    copies: Mapping[str, DataFrame], keys: Sequence[str], values: Sequence[str], levels: int = LEVELS, bits: int = BITS,
    digests: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """(copy, keys, difference): keys that a copy lacks, has besides or holds with other values, set against the first copy.

    ``difference`` is ``missing``, ``extra`` or ``changed``. The digests of all copies are compared from the top down; only rows
    whose ranges differ are shuffled and compared by key. Digests kept from :func:`range_digests` may be given, so that an
    unchanged copy need not be read for them. A key with several rows is held by the set of them: it is changed unless the
    copies have the same rows as often. Null keys and values agree with each other.
    """
    names = list(copies)
    known = dict(digests or {})
    for name in names:
        if name not in known:
            known[name] = written(range_digests(copies[name], keys, values, levels, bits), "digests")
    first, found = names[0], []
    whole = F.xxhash64(*[F.col(c) for c in (*keys, *values)])
    at = _range(keys, levels * bits)

    def held(df: DataFrame, ranges: DataFrame) -> DataFrame:
        """One row per key of the ranges: how many rows it has and the digest of them."""
        rows = df.select(*keys, at.alias("range"), whole.alias("_h")).join(ranges, "range", "left_semi")
        return rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.sum(F.col("_h").cast("decimal(20,0)")).alias("_t"), F.bit_xor("_h").alias("_x"))

    for name in names[1:]:
        ranges = bounded(differing_ranges(known[first], known[name], levels, bits), 16)
        mine = held(copies[first], ranges).withColumn("_side", F.lit(1))
        theirs = held(copies[name], ranges).withColumn("_side", F.lit(2))
        # Grouping takes two nulls for equal, as a join on the keys would not.
        both = mine.unionByName(theirs).groupBy(*keys).agg(
            F.count("*").alias("_sides"), F.max("_side").alias("_side"), F.count_distinct("_n", "_t", "_x").alias("_versions")
        )
        difference = F.when(F.col("_sides") == 2, F.lit("changed")).when(F.col("_side") == 1, "missing").otherwise("extra")
        found.append(both.filter("_sides = 1 OR _versions > 1").select(F.lit(name).alias("copy"), *keys, difference.alias("difference")))
    return reduce(DataFrame.unionByName, found)
