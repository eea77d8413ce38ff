"""Order MinHash fingerprints of whole texts.

A text is the set of its runs of ``RUN`` code points, each numbered by its occurrence. Under each of ``SLOTS`` random orders
the ``PICKED`` least are selected; kept in the order of the text they make a tuple, whose hash is one slot of the
fingerprint. Two slots are equal only if the same runs stand in the same order, so the share of equal slots follows the
edit distance where plain MinHash would see only the common runs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import add_columns, column, sha256, texts_of
from tidemark.llm.words import mixed
from tidemark.operators.skew import hot_hashes

RUN, SLOTS, PICKED = 5, 32, 2
#: Rows of one stretch of neighbours, and how many stretches there can be.
STRETCH, MOST_STRETCHES = 4_000, 10_000

_ODD = mixed(np.arange(1, SLOTS + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
_ADD = mixed(np.arange(101, SLOTS + 101, dtype=np.uint64)).astype(np.uint32)


def run_codes(text: str) -> np.ndarray:
    """A 64-bit hash for each run of code points; a shorter text is one run, an empty one has none."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    width = min(RUN, len(codes))
    if not width:
        return codes
    hashed = np.full(len(codes) - width + 1, np.uint64(width))
    for k in range(width):
        hashed = hashed * np.uint64(0xD1342543DE82EF95) + codes[k : len(codes) - width + 1 + k] + np.uint64(1)
    return mixed(hashed)


def slots_of(codes: np.ndarray) -> np.ndarray:
    """The fingerprint of a text from its run codes: one 32-bit value for each order."""
    n = len(codes)
    if not n:
        return np.zeros(SLOTS, np.uint32)
    # Sorting (code, position) numbers the occurrences without moving anything back.
    keys = np.sort((codes & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64))
    place = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
    high = keys >> np.uint64(32)
    index = np.arange(n)
    fresh = np.ones(n, bool)
    fresh[1:] = high[1:] != high[:-1]
    numbered = mixed(high * np.uint64(0x9E3779B97F4A7C15) + (index - np.maximum.accumulate(np.where(fresh, index, 0))).astype(np.uint64))
    short = numbered.astype(np.uint32)
    chosen = np.empty((SLOTS, min(PICKED, n)), np.int64)
    step = SLOTS if n < 50_000 else 1
    for at in range(0, SLOTS, step):
        order = short[None, :] * _ODD[at : at + step, None] + _ADD[at : at + step, None]
        rows = np.arange(len(order))
        for k in range(chosen.shape[1]):
            least = order.argmin(axis=1)
            chosen[at : at + step, k] = least
            order[rows, least] = np.uint32(0xFFFFFFFF)
    ranks = np.argsort(place[chosen], axis=1, kind="stable")
    picked = numbered[np.take_along_axis(chosen, ranks, axis=1)]
    value = np.full(SLOTS, np.uint64(PICKED))
    for k in range(picked.shape[1]):
        value = mixed(value * np.uint64(0xD1342543DE82EF95) + picked[:, k])
    return (value >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def written(slots: np.ndarray) -> str:
    return slots.astype(">u4").tobytes().hex()


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    """Share of equal slots."""
    return float((one == other).mean())


def fingerprints(df: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds ``fingerprint``, the hexadecimal slots of each whole text.

    Null and empty texts share one fingerprint of zeros; equal texts have equal ones. Other columns pass through, one called
    ``fingerprint`` is replaced.
    """
    return add_columns(
        df, text, "fingerprint string", lambda batch: [pa.array([written(slots_of(run_codes(t))) for t in texts_of(batch)], pa.string())], keep_text
    )


def _stretch(value: Column, borders: list[int]) -> Column:
    """How many of the descending ``borders`` are above ``value``, by two short searches."""
    if not borders:
        return F.lit(0)
    width = max(1, int(len(borders) ** 0.5))
    groups = [borders[k : k + width] for k in range(0, len(borders), width)]
    full = F.size(F.filter(F.array(*[F.lit(g[-1]) for g in groups]), lambda border: border > value))
    rows = F.array(*[F.array(*[F.lit(b) for b in g]) for g in groups])
    rest = F.size(F.filter(F.element_at(rows, F.least(full + 1, F.lit(len(groups)))), lambda border: border > value))
    return F.when(full == len(groups), F.lit(len(borders))).otherwise(full * width + rest).cast("int")


def in_descending_order(df: DataFrame, key: str, text: str) -> DataFrame:
    """(stretch, carried, key, text) dealt so that each row's successor is the next row of its partition.

    Rows go by descending ``key``, nulls last, equal keys by a hash of the text. They are cut into stretches of about
    ``STRETCH`` rows; the first row of each stretch is also carried to the end of the one before, that of the first to the end
    of the last. A key with more rows than two stretches is cut at hashes of its texts, into ``piece`` after ``piece``; rows that
    are equal stay together. Texts move once; only ids and hashes are read to place the borders, of which there are at most
    ``MOST_STRETCHES`` between keys.
    """
    lowest = -(1 << 63)
    rows = df.select(
        F.coalesce(column(key).cast("long"), F.lit(lowest)).alias("_key"), column(key).alias("key"), F.coalesce(column(text), F.lit("")).alias("text")
    ).withColumn("_hash", F.xxhash64("text"))
    total = df.count()
    parts = max(1, min(MOST_STRETCHES, max(48, total // STRETCH)))
    shares = [k / parts for k in range(1, parts)]
    found = rows.agg(F.percentile_approx("_key", F.array(*[F.lit(s) for s in shares]) if shares else F.array(F.lit(0.5)), 20 * MOST_STRETCHES)).first()[0] if total else []
    borders = sorted({b for b in found or [] if b > lowest}, reverse=True)
    width = max(STRETCH, -(-total // parts))
    hot = {h: n for h, n in hot_hashes(rows, ["_key"], width).items() if n > 2} if total > 2 * width else {}
    placed = rows.withColumn("stretch", _stretch(F.col("_key"), borders))
    if hot:
        pieces = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in hot.items() for x in pair]), F.xxhash64("_key")), F.lit(1))
        # The place of the hash among all hashes, in as many pieces: it grows with the hash, as the order of the rows does.
        piece = F.least(F.floor((F.col("_hash") / F.lit(2.0**64) + 0.5) * pieces), pieces - 1).cast("int")
        # A key of more than two stretches is a border, so it shares its stretch with no other such key; the keys before it stay together.
        known = placed.where(pieces > 1).groupBy("stretch").agg(F.max("_key").alias("_hot"), F.min("_key").alias("_least")).where("_hot = _least").drop("_least")
        own = F.col("_key") == F.col("_hot")
        placed = placed.join(F.broadcast(known), "stretch", "left").withColumns({
            "side": F.when(F.col("_hot").isNull() | (F.col("_key") > F.col("_hot")), 0).when(own, 1).otherwise(2),
            "piece": F.when(own, piece).otherwise(0),
        }).drop("_hot")
    else:
        placed = placed.withColumns({"side": F.lit(0), "piece": F.lit(0)})
    group = ["stretch", "side", "piece"]
    heads = placed.groupBy(*group).agg(F.min(F.struct(F.bitwise_not("_key").alias("k"), F.col("_hash").alias("h"))).alias("head")).orderBy(*group).collect()
    rows = placed.withColumn("carried", F.lit(False))
    if heads:
        spark = df.sparkSession
        before = [(~row["head"]["k"], row["head"]["h"], *[heads[k - 1][g] for g in group]) for k, row in enumerate(heads)]
        carried = spark.createDataFrame(before, "_key long, _hash long, _stretch int, _side int, _piece int")
        copies = placed.join(F.broadcast(carried), ["_key", "_hash"]).select(
            "_key", "key", "text", "_hash", *[F.col(f"_{g}").alias(g) for g in group], F.lit(True).alias("carried")
        )
        rows = rows.unionByName(copies)
    dealt = rows.repartitionByRange(max(1, len(heads)), *group)
    ordered = dealt.sortWithinPartitions(*group, "carried", F.desc("_key"), "_hash", "text")
    return ordered.select(F.concat_ws("/", *group).alias("stretch"), "carried", "key", "text")


def compare_edited(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints each text and its edited form and compares both with it and with the next document's.

    In the edited form the last half of the code points, rounded down, is replaced by as many first ones, or all, of the next
    document by descending ``key``; the first follows the last, and a single row follows itself. Nulls of ``text`` count
    as empty, rows with a null key come last, rows with equal keys go by a hash of their text. Only ``key`` and ``text`` are
    read.
    """
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            out = {name: [] for name in names}
            for stretch, carried, value, own in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3)):
                own = own.as_py()
                slots = slots_of(run_codes(own)) if not carried or waiting is not None else None
                if waiting is not None:
                    known, old, old_slots = waiting
                    half = len(old) // 2
                    edited = old[: len(old) - half] + own[:half]
                    edited_slots = slots_of(run_codes(edited))
                    row = (known, len(old), sha256(edited), written(old_slots), written(edited_slots), likeness(old_slots, edited_slots), likeness(old_slots, slots))
                    for name, cell in zip(names, row):
                        out[name].append(cell)
                waiting = None if carried else (value, own, slots)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[key], batch.column(2).type), pa.array(out["n_chars"], pa.int64()), *[pa.array(out[n], pa.string()) for n in names[2:5]], *[pa.array(out[n], pa.float64()) for n in names[5:]]],
                names=names,
            )

    return in_descending_order(df, key, text).mapInArrow(run, schema)
