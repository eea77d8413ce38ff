"""Mixing sources to target weights by pivotal dependent rounding.

Every source has a target in words, so each of its documents should be taken ``target / source size`` times. The whole
part of that number is taken at once; the fraction is a probability that is rounded so that the words of the source stay
at its target: two fractional documents meet, mass worth the same number of words moves from one to the other, in a random
direction that leaves both probabilities right on average, until one of them is 0 or 1. The other one, the residual, meets
the next document. A task leaves one residual for each of its groups; residuals of up to ``FAN`` groups meet on the next
level of the tree, and the last one of a source is rounded by itself. Its size is all that a source can miss its target by,
so larger documents are paired first and what is left is small.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import add_columns, buffer_of, column, hot_join, hot_keys, set_aside
from tidemark.llm.words import SPACED, slices, word_bounds
from tidemark.session import written

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix, as a multiple of the words of all documents, and most words of a source, as a multiple of its own.
SHARE, MOST = 1.5, 2.0
#: Documents of one group of the tree's lowest level, and groups whose residuals meet in one of the next.
LEAF, FAN = 4_096, 256

_MASK = (1 << 64) - 1
_OWN = ("_no", "_bucket", "_order", "_size", "_whole", "_part")


def word_counts(array: pa.Array) -> np.ndarray:
    """Number of words between white space of each text; null has none."""
    offsets, data = buffer_of(array)
    counts = [np.diff(word_bounds(data, offsets[first : last + 1], SPACED)[2]) for first, last in slices(offsets)]
    return np.concatenate(counts).astype(np.int64) if counts else np.empty(0, np.int64)


def with_sizes(df: DataFrame, text: str = "text", name: str = "size", keep_text: bool = False) -> DataFrame:
    """Adds the number of words of ``text`` as ``name``; null and empty texts have none."""
    return add_columns(df, text, f"`{name}` bigint", lambda array: [pa.array(word_counts(array))], keep_text)


def _numbered(sources: DataFrame) -> DataFrame:
    """Adds ``_no``, the place of each source by code point, null last, without gathering the sources in one task."""
    ordered = sources.repartitionByRange(F.col("source").isNull(), F.col("source")).sortWithinPartitions(F.col("source").isNull(), "source")
    placed = written(ordered.withColumn("_id", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("_id", 33).alias("_slice")
    # One row for each task of the sort: their number does not follow the sources.
    slices_ = placed.groupBy(part).agg(F.count("*").alias("n")).orderBy("_slice").collect()
    before, offsets = 0, {}
    for row in slices_:
        offsets[row["_slice"]] = before
        before += row["n"]
    if not offsets:
        return placed.withColumn("_no", F.lit(0).cast("long")).drop("_id")
    offset = F.create_map(*[F.lit(v).cast("long") for pair in offsets.items() for v in pair])
    return placed.withColumn("_no", F.element_at(offset, F.shiftright("_id", 33)) + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id")


def source_targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, rows, _no, weight, target) from (source, source_size, rows).

    The sources in order of their code points, null last, have the weights in turn and share ``share`` times all words. No
    target is above ``most`` times its source's words; what that cuts off is shared by weight among the others, again until
    none is above. Every round is one aggregate over the sources; a source that is at its limit stays there.
    """
    if most < share:
        raise ValueError("the sources cannot give so many words")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_no") % len(weights) + 1).cast("int"))
    known = written(_numbered(sources).withColumn("weight", weight), "weighted")
    total = known.agg(F.sum("source_size")).first()[0] or 0
    limit, level, capped = F.col("source_size") * float(most), 0.0, -1
    while True:
        above = limit < F.col("weight") * level
        row = known.agg(
            F.coalesce(F.sum(F.when(above, F.col("source_size"))), F.lit(0)).alias("held"), F.sum(F.when(~above, F.col("weight"))).alias("open"),
            F.count(F.when(above, 1)).alias("capped"),
        ).first()
        if row["capped"] == capped or not row["open"]:
            break
        capped, level = row["capped"], (share * total - most * row["held"]) / row["open"]
    return known.withColumn("target", F.when(limit < F.col("weight") * level, limit).otherwise(F.col("weight") * level))


def chance(one: int, other: int, salt: int) -> float:
    """A number from 0 to 1 that depends on nothing but its arguments."""
    value = (one * 0x9E3779B97F4A7C15 + other * 0xC2B2AE3D27D4EB4F + salt * 0x165667B19E3779F9 + 0x27D4EB2F165667C5) & _MASK
    value = ((value ^ (value >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    value = ((value ^ (value >> 27)) * 0x94D049BB133111EB) & _MASK
    return ((value ^ (value >> 31)) >> 11) / (1 << 53)


def transfer(size: int, part: float, other_size: int, other: float, draw: float) -> tuple[float, float]:
    """Both probabilities after words have moved between two fractional documents; one of them at least is 0 or 1.

    Words are kept: ``size * part + other_size * other`` stays. Each probability stays as it is on average over ``draw``.
    """
    up = min(size * (1 - part), other_size * other)
    down = min(size * part, other_size * (1 - other))
    if draw * (up + down) < down:
        full, empty = size * (1 - part) <= up, other_size * other <= up
        return (1.0 if full else part + up / size), (0.0 if empty else other - up / other_size)
    empty, full = size * part <= down, other_size * (1 - other) <= down
    return (0.0 if empty else part - down / size), (1.0 if full else other + down / other_size)


def _level(rows: DataFrame, level: int, seed: int, last: bool) -> DataFrame:
    """One level of the tree: all documents of a group settled but one."""
    names = rows.columns
    at = {name: names.index(name) for name in _OWN}
    fields = rows.schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, None

        def out(row: pa.RecordBatch, parts: list[float]) -> pa.RecordBatch:
            columns = list(row.columns)
            columns[at["_part"]] = pa.array(parts, pa.float64())
            return pa.RecordBatch.from_arrays(columns, names=names)

        def ended() -> Iterator[pa.RecordBatch]:
            if held is not None:
                order, _, part, row = held
                yield out(row, [float(chance(order, order, seed * 64 + level) < part) if last else part])

        for batch in batches:
            ids = zip(batch.column(at["_no"]).to_pylist(), batch.column(at["_bucket"]).to_pylist())
            orders = batch.column(at["_order"]).to_pylist()
            sizes, parts = batch.column(at["_size"]).to_pylist(), batch.column(at["_part"]).to_pylist()
            settled, mine = np.ones(batch.num_rows, bool), None
            for k, own in enumerate(ids):
                if own != group:
                    if mine is not None:
                        held = (held[0], held[1], held[2], batch.slice(mine, 1))
                        settled[mine] = False
                    yield from ended()
                    group, held, mine = own, None, None
                if not 0 < parts[k] < 1:
                    continue
                if held is None:
                    held, mine = (orders[k], sizes[k], parts[k], None), k
                    continue
                order, size, part, row = held
                part, parts[k] = transfer(size, part, sizes[k], parts[k], chance(order, orders[k], seed * 64 + level))
                if 0 < part < 1:
                    held = (order, size, part, row)
                    continue
                if mine is None:
                    yield out(row, [part])
                else:
                    parts[mine] = part
                held, mine = ((orders[k], sizes[k], parts[k], None), k) if 0 < parts[k] < 1 else (None, None)
            if mine is not None:
                settled[mine] = False
                # A copy of the one row, not a view that keeps its batch.
                held = (held[0], held[1], held[2], batch.take(pa.array([mine])))
            where = np.flatnonzero(settled)
            yield out(batch.take(pa.array(where)), [parts[k] for k in where.tolist()])
        yield from ended()

    dealt = rows.repartition("_no", "_bucket").sortWithinPartitions("_no", "_bucket", F.desc("_size"), "_order")
    return dealt.mapInArrow(run, fields)


def copies_to_target(
    df: DataFrame, size: str = "size", source: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE,
    most: float = MOST, seed: int = 0, leaf: int = LEAF, fan: int = FAN,
) -> DataFrame:
    """Adds ``source_size``, ``target`` and ``copies``, how often the mix takes each row.

    Rows of a source are taken ``target / source_size`` times on average, each the whole part of that or once more. All other
    columns pass through; those with the names of new ones are replaced. A null ``size`` counts as 0; rows of size 0 are
    taken the whole part of the average. A null source is a source of its own, after the others. Equal rows and rows with
    equal or null keys are drawn each on their own. Which rows are drawn follows from ``seed`` and the rows' values (all
    but maps), not from how they are partitioned. A table without rows stays empty.
    """
    added = ("source_size", "target", "copies")
    kept = [c for c in df.columns if c.lower() not in added]
    df, back = set_aside(df.select(*[column(c) for c in kept]), [*_OWN, "_name", "_salt", "salts"])
    moved = {old: new for new, old in back.items()}
    names = {c: moved.get(c, c) for c in kept}
    own = F.coalesce(column(names[size]).cast("long"), F.lit(0))
    label = F.when(column(names[source]).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), column(names[source]).cast("string")))
    plain = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    rows = written(df.withColumns({"_size": own, "_name": label, "_order": F.xxhash64(*[column(c) for c in plain])}), "sizes")
    sources = rows.groupBy("_name").agg(F.sum("_size").alias("source_size"), F.count("*").alias("rows")).withColumn(
        "source", F.when(F.col("_name") == "n", F.lit(None)).otherwise(F.expr("substr(_name, 2)"))
    )
    targets = written(source_targets(sources, weights, share, most), "targets")
    counts = targets.agg(F.sum("rows").alias("rows"), F.max("rows").alias("most")).first()
    average = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    shares = targets.select(
        "_name", "_no", "source_size", "target", F.floor(average).alias("_whole"), (average - F.floor(average)).alias("_part"),
        F.ceil(F.col("rows") / leaf).alias("_groups"),
    )
    joined = hot_join(rows, shares, "_name", hot_keys(targets, "_name", "rows", counts["rows"] or 0, 1_000_000), "_order")
    level = joined.withColumn("_bucket", F.pmod("_order", "_groups")).withColumn("_part", F.when(F.col("_size") > 0, F.col("_part")).otherwise(F.lit(0.0))).drop("_groups", "_name")
    groups, done, depth = -(-(counts["most"] or 1) // leaf), [], 0
    while True:
        last = groups <= 1
        level = written(_level(level, depth, seed, last), "mixed")
        settled = (F.col("_part") == 0) | (F.col("_part") == 1)
        done.append(level.where(settled))
        if last:
            break
        level = level.where(~settled).withColumn("_bucket", F.floor(F.col("_bucket") / fan))
        groups, depth = -(-groups // fan), depth + 1
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    copies = (F.col("_whole") + F.col("_part").cast("long")).alias("copies")
    return result.select(*[column(names[c]).alias(c) for c in kept], "source_size", "target", copies)


def mixed_corpus(df: DataFrame, text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: every row of ``df`` as often as it is drawn, with all its columns.

    Sizes are words of ``text``. ``options`` and the cases are those of :func:`copies_to_target`.
    """
    named, back = set_aside(df, ("_words", "source_size", "target", "copies"))
    moved = {old: new for new, old in back.items()}
    place = {c: moved.get(c, c) for c in (text, source)}
    drawn = copies_to_target(with_sizes(named, place[text], "_words", keep_text=True), "_words", place[source], **options)
    repeated = drawn.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return repeated.select(*[column(c) for c in named.columns]).withColumnsRenamed(back).select(*[column(c) for c in df.columns])


def mixing_digest(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: its size, its source's size and target, and the words that the mix takes of it."""
    sized = with_sizes(df.select(column(key), column(source), column(text)), text)
    drawn = copies_to_target(sized, source=source)
    return drawn.select(column(key), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
