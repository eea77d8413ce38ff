"""Periodic runs of words: stretches that repeat a period at least ``TIMES`` times, found on tiles by octave of the period.

Periods are taken octave by octave, B to 2 B - 1. For an octave every document has an anchor each B words. A run with a
period q of the octave holds anchors c for which 2 B words from c on equal those from c + q on; a fingerprint of 2 B words
at every position says which anchors can be such. Only tiles, overlapping stretches of the document, with such anchors are
sent on. They are solved independently of each other: from each anchor a Z-function forwards and one backwards give the
reach of all periods of the octave at once, clipped to the tile. The fragments meet by document and period, where those
that overlap by a period are stitched.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.batches import buffer_of, column
from tidemark.llm.words import mixed, slices
from tidemark.session import written

#: A run repeats its period so often at least, and has so many words at least.
TIMES, LEAST = 4, 6
#: Words between the first anchors of neighbouring tiles; of four largest-octave blocks where those are longer.
TILE_WORDS = 4_096

#: Bytes of text that are cut to words at once.
SLICE_BYTES = 1 << 20

_STEP = np.uint64(0xD1342543DE82EF95)


def word_ids(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word of several texts, equal for equal words alone, and the first word of each text (n + 1)."""
    firsts = np.concatenate([[0], np.cumsum([len(words) for words in texts])]).astype(np.int64)
    if not firsts[-1]:
        return np.empty(0, np.int32), firsts
    return pa.array([w for words in texts for w in words], pa.large_binary()).dictionary_encode().indices.to_numpy().astype(np.int32), firsts


def anchors_by_octave(ids: np.ndarray, firsts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(octave, anchors) at which a run with a period of the octave can stand; every run has an anchor each B of its words."""
    longest, octave = int(np.diff(firsts).max(initial=0)), 0
    print_ = mixed(ids.astype(np.uint64) + np.uint64(1))
    while TIMES << octave <= longest:
        block = 1 << octave
        print_ = print_[:-block] * _STEP + print_[block:]
        print_ ^= print_ >> np.uint64(29)
        padded = np.zeros(-(-len(print_) // block) * block, np.uint64)
        padded[: len(print_)] = print_
        table = padded.reshape(-1, block)
        at, ahead = np.nonzero(table[1:] == table[:-1, :1])
        anchor = at * block
        end = firsts[np.searchsorted(firsts, anchor, side="right")]
        fits = anchor + block + ahead + 2 * block <= end
        yield octave, np.unique(anchor[fits])
        octave += 1


def z_values(words: list[int], most: int) -> list[int]:
    """For each of the first ``most`` positions, how many words from there on equal those at the start."""
    n = len(words)
    values, left, right = [n] + [0] * (min(most, n) - 1), 0, 0
    for i in range(1, min(most, n)):
        reach = min(right - i, values[i - left]) if i < right else 0
        while i + reach < n and words[reach] == words[i + reach]:
            reach += 1
        if i + reach > right:
            left, right = i, i + reach
        values[i] = reach
    return values


def _prime_factors(number: int) -> list[int]:
    found, factor = [], 2
    while factor * factor <= number:
        if number % factor == 0:
            found.append(factor)
            while number % factor == 0:
                number //= factor
        factor += 1
    return found + [number] * (number > 1)


def solved(words: list[int], anchors: list[int], octave: int) -> dict[int, list[tuple[int, int]]]:
    """For each period of the octave, the fragments (start, end) of stretches with that smallest period around the anchors."""
    block, found = 1 << octave, {}
    for c in anchors:
        left, right = max(0, c - block - 1), min(len(words), c + 6 * block)
        forward = z_values(words[c:right], 2 * block)
        periods = [q for q in range(block, min(2 * block, len(forward))) if forward[q] >= 2 * block]
        # With q, its part p is a period too where the first q words already repeat p.
        periods = [q for q in periods if not any(forward[q // prime] >= q - q // prime for prime in _prime_factors(q))]
        if not periods:
            continue
        stop = min(len(words), c + 2 * block - 1)
        back = z_values(words[left:c][::-1] + [-1] + words[left:stop][::-1], c - left + 1 + stop - left)
        for q in periods:
            start = c - (back[c - left + 1 + stop - c - q] if c > left else 0)
            end = c + q + forward[q]
            own = found.setdefault(q, [])
            if own and start <= own[-1][1] - q:
                own[-1] = (own[-1][0], max(own[-1][1], end))
            else:
                own.append((start, end))
    return found


def _packed(ids: np.ndarray) -> bytes:
    """Numbers of words as two bytes each, or four where there are too many, after a byte that says which."""
    known, own = np.unique(ids, return_inverse=True)
    return b"\x02" + own.astype("<u2").tobytes() if len(known) < 1 << 16 else b"\x04" + own.astype("<u4").tobytes()


def _unpacked(raw: bytes) -> list[int]:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).tolist()


def _result(words: bytes, keep_text: bool) -> str:
    return words.decode("utf-8", "surrogatepass") if keep_text else hashlib.sha256(words).hexdigest()


def tiles(df: DataFrame, key: str, text: str, tile_words: int, keep_text: bool) -> DataFrame:
    """One row per document (``octave`` null) and one per tile that can hold a run, both with the document's ``row``.

    A document without such a tile has its result at once in ``collapsed``: its words joined by spaces, or without
    ``keep_text`` the hash of that. One with tiles has its joined words in ``words``. Words of a tile are numbered anew, so that
    two bytes are enough for each of them in all but the largest.
    """
    rows = df.select(F.monotonically_increasing_id().alias("row"), column(key).alias("key"), column(text).cast("string").alias("text"))
    schema = T.StructType([
        rows.schema["row"], rows.schema["key"],
        *T._parse_datatype_string("n bigint, collapsed string, words binary, octave int, at bigint, anchors binary, ids binary").fields,
    ])
    names = schema.names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            borders_of = buffer_of(whole.column(2))[0]
            for batch in (whole.slice(a, b - a) for a, b in slices(borders_of, SLICE_BYTES)):
                offsets, data = buffer_of(batch.column(2))
                raw = data[offsets[0] : offsets[-1]].tobytes()
                cuts = (offsets - offsets[0]).tolist()
                # bytes.split() cuts at space and U+0009 to U+000D.
                texts = [raw[a:b].split() for a, b in zip(cuts[:-1], cuts[1:])]
                ids, firsts = word_ids(texts)
                sent = {name: [] for name in ("doc", "octave", "at", "anchors", "ids")}
                for octave, anchors in anchors_by_octave(ids, firsts):
                    block = 1 << octave
                    docs = np.searchsorted(firsts, anchors, side="right") - 1
                    core = max(tile_words, 4 * block)
                    part = (anchors - firsts[docs]) // core
                    borders = np.flatnonzero((np.diff(docs, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0))
                    for a, b in zip(borders.tolist(), [*borders[1:].tolist(), len(anchors)]):
                        first, last = int(firsts[docs[a]]), int(firsts[docs[a] + 1])
                        begin = first + int(part[a]) * core
                        start, end = max(first, begin - block - 1), min(last, begin + core + 6 * block)
                        sent["doc"].append(int(docs[a]))
                        sent["octave"].append(octave)
                        sent["at"].append(start - first)
                        sent["anchors"].append((anchors[a:b] - start).astype(np.int32).tobytes())
                        sent["ids"].append(_packed(ids[start:end]))
                marked = set(sent["doc"])
                joined = [b" ".join(words) for words in texts]
                whole_rows = len(texts)
                order = pa.array([*range(whole_rows), *sent["doc"]], pa.int64())
                nothing = [None] * whole_rows
                none = [None] * len(sent["doc"])
                cells = [
                    pa.array([*map(len, texts), *none], pa.int64()),
                    pa.array([None if k in marked else _result(j, keep_text) for k, j in enumerate(joined)] + none, pa.string()),
                    pa.array([j if k in marked else None for k, j in enumerate(joined)] + none, pa.binary()),
                    pa.array([*nothing, *sent["octave"]], pa.int32()), pa.array([*nothing, *sent["at"]], pa.int64()),
                    pa.array([*nothing, *sent["anchors"]], pa.binary()), pa.array([*nothing, *sent["ids"]], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(order), batch.column(1).take(order), *cells], names=names)

    return rows.mapInArrow(run, schema)


def fragments(cut: DataFrame) -> DataFrame:
    """(row, period, start, end) of the stretches found on each tile, in words of the document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ([], [], [], [])
            # Row by row, so that only one tile is unpacked at a time.
            for row, octave, at, anchors, ids in ([c[k].as_py() for c in batch.columns] for k in range(batch.num_rows)):
                got = solved(_unpacked(ids), np.frombuffer(anchors, np.int32).tolist(), octave)
                for period, stretches in got.items():
                    for start, end in stretches:
                        for column_, cell in zip(out, (row, period, at + start, at + end)):
                            column_.append(cell)
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names=["row", "period", "start", "end"])

    dealt = cut.where("octave is not null").select("row", "octave", "at", "anchors", "ids").repartition("row", "octave", "at")
    return dealt.mapInArrow(run, "row bigint, period bigint, start bigint, end bigint")


def stitched(found: DataFrame, times: int = TIMES, least: int = LEAST) -> DataFrame:
    """(row, start, length, period) of whole runs: fragments of a period that overlap by the period are of one run."""
    order = Window.partitionBy("row", "period").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = found.withColumn("fresh", F.when(before.isNull() | (F.col("start") > before - F.col("period")), 1).otherwise(0))
    runs = fresh.withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("row", "period", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end")
    )
    length = F.col("end") - F.col("start")
    return runs.where(length >= F.greatest(F.lit(least), times * F.col("period"))).select("row", "start", length.alias("length"), "period")


def _collapsed(rows: DataFrame, keep_text: bool) -> DataFrame:
    """``rows`` with their words without what the runs repeat, as text or as its hash."""
    names = ["key", "n", "runs", "collapsed"]
    schema = T.StructType([rows.schema["key"], rows.schema["n"], rows.schema["runs"], T.StructField("collapsed", T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, runs in ((batch.column(2)[k].as_py(), batch.column(3)[k].as_py()) for k in range(batch.num_rows)):
                if runs:
                    words, kept, at = raw.split(b" "), [], 0
                    for first, last in sorted((r["start"] + r["period"], r["start"] + r["length"]) for r in runs):
                        kept.extend(words[at : max(at, first)])
                        at = max(at, last)
                    raw = b" ".join(kept + words[at:])
                out.append(_result(raw, keep_text))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(out, pa.string())], names=names)

    return rows.select("key", "n", "words", "runs").mapInArrow(run, schema)


def periodic_runs(df: DataFrame, key: str = "doc_id", text: str = "text", keep_text: bool = True, tile_words: int = TILE_WORDS) -> DataFrame:
    """(key, n, runs, collapsed): the number of words, the runs by start and period, and the words without what runs repeat.

    Words are cut at ASCII white space. A run is a stretch with smallest period q of at least 4 q and 6 words that no
    neighbouring word extends; ``runs`` has (start, length, period) of every one, in words from 0. ``collapsed`` are the kept
    words joined by a space, those of a run after its first q words left out, or with ``keep_text`` false their SHA-256.
    A null or empty text has no words. Repeated rows and rows with null or equal keys stand each for themselves. Columns other
    than ``key`` and ``text`` are not read. A table without rows gives none.
    """
    cut = written(tiles(df, key, text, tile_words, keep_text), "tiles")
    runs = stitched(fragments(cut)).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))
    none = F.array().cast("array<struct<start:bigint,length:bigint,period:bigint>>")
    documents = cut.where("octave is null")
    # Only documents with tiles meet their runs; the others are done.
    joined = documents.where("words is not null").select("row", "key", "n", "words").join(runs, "row", "left")
    done = documents.where("words is null").select("key", "n", none.alias("runs"), "collapsed")
    return done.unionByName(_collapsed(joined.withColumn("runs", F.coalesce("runs", none)), keep_text)).withColumnRenamed("key", key)


def runs_digest(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the number of runs, the one with the greatest exponent, and hashes of all runs and of the rest."""
    found = periodic_runs(df, key, text, keep_text=False)
    # Exponents are compared as fractions; of equal ones the first in order of start and period stays.
    best = F.aggregate(
        F.expr("slice(runs, 2, greatest(size(runs), 1))"), F.get("runs", F.lit(0)),
        lambda held, run: F.when(run["length"] * held["period"] > held["length"] * run["period"], run).otherwise(held),
    )
    lines = F.array_join(F.transform("runs", lambda run: F.concat_ws(",", run["start"], run["length"], run["period"])), "\n")
    listed = F.when(F.size("runs") == 0, F.lit("")).otherwise(F.concat(lines, F.lit("\n")))
    return found.withColumn("best", best).select(
        column(key), F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.expr("best.length * 1000 div best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256"),
    )


def planted(doc_id, words: list[bytes]) -> list[bytes]:
    """The words with their end turned into a repetition, for one id in ten; which one and how follows from the id."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def with_planted_runs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) with a repetition planted in one document of ten; see :func:`planted`. Null texts stay null."""
    rows = df.select(column(key), column(text))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            chosen = [k for k, doc_id in enumerate(ids) if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0]
            if chosen:
                new = {k: batch.column(1)[k].as_py() for k in chosen}
                new = {k: b" ".join(planted(ids[k], t.encode("utf-8", "surrogatepass").split())).decode("utf-8", "surrogatepass") for k, t in new.items() if t is not None}
                mask = np.zeros(batch.num_rows, bool)
                mask[list(new)] = True
                texts = pc.replace_with_mask(batch.column(1), pa.array(mask), pa.array([new[k] for k in sorted(new)], batch.column(1).type))
                batch = pa.RecordBatch.from_arrays([batch.column(0), texts], names=batch.schema.names)
            yield batch

    return rows.mapInArrow(run, rows.schema)
