"""Ranked lexical search by presence masks.

Documents are indexed in blocks: the distinct terms of a block with the documents that hold them. A set of stated queries
(items) then runs over the blocks. Within a block every term of an item sets one bit in the masks of its documents, so that
the documents fall into groups of equal masks. A mask has a maximum score, the sum of the greatest contributions of its terms
in the block; masks are evaluated by descending maximum until it is below the last score that can still be among the best.

Terms are compared by 64-bit hashes; equal hashes of different terms are not told apart.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.batches import buffer_of, column
from tidemark.llm.words import LETTERED, slices, word_bounds, word_hashes
from tidemark.session import written

#: Results of an item.
BEST = 50
#: A block of the index is closed at so many words or documents, whichever comes first.
BLOCK_WORDS, BLOCK_DOCUMENTS = 1_000_000, 50_000
#: Terms of the items that run over the index together: what is sent to the executors at once.
ITEM_TERMS = 200_000
#: One block in so many is read first for a lower bound of every item's last score.
PROBED = 64

_INDEX = "probe int, documents bigint, words bigint, lengths binary, terms binary, ends binary, places binary, counts binary"


def _terms(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and end row, term hashes in order and the number of terms of each row, slice by slice."""
    offsets, data = buffer_of(batch.column(at))
    for first, last in slices(offsets):
        part = offsets[first : last + 1]
        starts, ends, firsts = word_bounds(data, part, LETTERED)
        yield first, last, word_hashes(data, int(part[0]), starts, ends), np.diff(firsts)


def _inverted(hashes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct terms, the end of each one's postings, and the postings: document places and occurrences."""
    coded = pa.array(hashes).dictionary_encode()
    terms = coded.dictionary.to_numpy(zero_copy_only=False).astype(np.uint64)
    order = np.argsort(terms)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    keys = rank[coded.indices.to_numpy()] << np.int64(32) | np.repeat(np.arange(len(lengths)), lengths)
    keys.sort()
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    where = np.flatnonzero(fresh)
    counts = np.diff(np.append(where, len(keys)))
    ends = np.cumsum(np.bincount(keys[where] >> np.int64(32), minlength=len(terms)))
    return terms[order], ends, keys[where] & np.int64(0xFFFFFFFF), counts


def index_blocks(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = BLOCK_WORDS) -> DataFrame:
    """The inverted index of whole texts, one row per block of documents.

    Texts without terms, null ones among them, are left out. Repeated rows and rows with null or equal keys each stand for
    themselves. Only ``key`` and ``text`` are read. A table without rows has no blocks.
    """
    rows = df.select(column(key).alias("key"), column(text).cast("string").alias("text"))
    schema = T.StructType([T.StructField("keys", T.ArrayType(rows.schema["key"].dataType)), *T._parse_datatype_string(_INDEX).fields])
    names = schema.names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, hashes, lengths, held = [], [], [], 0

        def block() -> pa.RecordBatch:
            keys, every, sizes = pa.concat_arrays(kept), np.concatenate(hashes), np.concatenate(lengths)
            terms, ends, places, counts = _inverted(every, sizes)
            raw = [sizes.astype(np.int32), terms, ends.astype(np.int32), places.astype(np.int32), counts.astype(np.int32)]
            cells = [zlib.crc32(every[:1000].tobytes()) % PROBED, len(sizes), int(sizes.sum()), *[r.tobytes() for r in raw]]
            listed = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
            kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([listed, *[pa.array([c], k) for c, k in zip(cells, kinds)]], names=names)

        for batch in batches:
            for first, last, found, sizes in _terms(batch, 1):
                there = np.flatnonzero(sizes)
                if len(there):
                    kept.append(batch.column(0).slice(first, last - first).take(pa.array(there)))
                    hashes.append(found)
                    lengths.append(sizes[there])
                    held += len(found)
                if held >= words or sum(map(len, lengths)) >= BLOCK_DOCUMENTS:
                    yield block()
                    kept, hashes, lengths, held = [], [], [], 0
        if kept:
            yield block()

    return rows.mapInArrow(run, schema)


def packed_items(items: DataFrame, item_id: str, text: str, most: int) -> DataFrame:
    """Items with their distinct terms, packed into rows of at most ``most`` terms or one item; items without terms are left out."""
    rows = items.select(column(item_id).alias("item"), column(text).cast("string").alias("text"))
    schema = T.StructType([T.StructField("items", T.ArrayType(rows.schema["item"].dataType)), *T._parse_datatype_string("ends binary, terms binary").fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, own, held = [], [], 0

        def pack() -> pa.RecordBatch:
            ids = pa.concat_arrays(kept)
            ends = np.cumsum([len(o) for o in own]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([listed, pa.array([ends.tobytes()], pa.binary()), pa.array([np.concatenate(own).tobytes()], pa.binary())], names=schema.names)

        for batch in batches:
            for first, last, hashes, sizes in _terms(batch, 1):
                at = np.concatenate([[0], np.cumsum(sizes)])
                for k in range(last - first):
                    terms = np.unique(hashes[at[k] : at[k + 1]])
                    if not len(terms):
                        continue
                    if held and held + len(terms) > most:
                        yield pack()
                        kept, own, held = [], [], 0
                    kept.append(batch.column(0).slice(first + k, 1))
                    own.append(terms)
                    held += len(terms)
        if kept:
            yield pack()

    return rows.mapInArrow(run, schema)


def _holders(index: DataFrame, vocabulary: np.ndarray) -> dict[int, int]:
    """For each of the terms that occurs, the number of documents that hold it."""
    sent = index.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for raw, ended in zip(batch.column(0), batch.column(1)):
                terms, ends = np.frombuffer(raw.as_buffer(), np.uint64), np.frombuffer(ended.as_buffer(), np.int32)
                where = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
                total += np.where(terms[where] == wanted, np.diff(ends, prepend=0)[where], 0)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["term", "n"])

    counted = index.select("terms", "ends").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    found = {row["term"]: row["n"] for row in counted.collect()}
    sent.destroy()
    return found


def term_weight(documents: int, holders: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holders + 1)))


def length_measures(lengths: np.ndarray, documents: int, words: int) -> np.ndarray:
    """How a document's length enters its score: 100 for the average one, at least 50."""
    if 50 * documents * int(lengths.max(initial=0)) < 1 << 63:
        return 50 + (50 * documents * lengths.astype(np.int64)) // words
    return np.array([50 + (50 * documents * n) // words for n in lengths.tolist()], np.int64)


class Block:
    """The postings of one block that belong to terms of the items, with what each adds to a score."""

    def __init__(self, row: dict[str, np.ndarray], vocabulary: np.ndarray, weights: np.ndarray, documents: int, words: int):
        terms, ends, places, counts = row["terms"], row["ends"], row["places"], row["counts"].astype(np.int64)
        self.size = len(row["lengths"])
        where = np.minimum(np.searchsorted(terms, vocabulary), len(terms) - 1)
        there = (terms[where] == vocabulary) & (weights > 0)
        begins = ends[where] - np.diff(ends, prepend=0)[where]
        sizes = np.where(there, ends[where] - begins, 0)
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        at = np.repeat(begins - self.begins, sizes) + np.arange(int(sizes.sum()))
        self.places = places[at]
        tf = counts[at]
        measure = length_measures(row["lengths"], documents, words)[self.places]
        self.adds = np.repeat(weights, sizes) * ((1_000_000_000 * tf) // (1000 * tf + 20 * measure))
        self.most = np.zeros(len(vocabulary), np.int64)
        held = np.flatnonzero(sizes)
        if len(held):
            self.most[held] = np.maximum.reduceat(self.adds, self.begins[held])

    def masks(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct presence masks (rows of bits), their maximum scores, and each document's mask or -1."""
        words = np.zeros((-(-len(terms) // 64), self.size), np.uint64)
        for k, term in enumerate(terms.tolist()):
            words[k >> 6, self.places[self.begins[term] : self.ends[term]]] |= np.uint64(1 << (k & 63))
        any_ = np.flatnonzero(words.any(axis=0))
        group = np.zeros(len(any_), np.int64)
        for word in words[:, any_]:
            own = np.unique(word, return_inverse=True)[1]
            group = np.unique(group * (int(own.max(initial=0)) + 1) + own, return_inverse=True)[1]
        of = np.full(self.size, -1, np.int64)
        of[any_] = group
        first = np.zeros(int(group.max(initial=-1)) + 1, np.int64)
        first[group] = any_
        bits = (words[:, first].repeat(64, axis=0)[: len(terms)] >> (np.arange(len(terms), dtype=np.uint64) & np.uint64(63))[:, None]) & np.uint64(1)
        return bits, self.most[terms] @ bits.astype(np.int64), of

    def scores(self, terms: np.ndarray, documents: np.ndarray) -> np.ndarray:
        """Whole scores of some documents."""
        total = np.zeros(len(documents), np.int64)
        for term in terms.tolist():
            places = self.places[self.begins[term] : self.ends[term]]
            where = np.minimum(np.searchsorted(places, documents), len(places) - 1)
            total += np.where(places[where] == documents, self.adds[self.begins[term] + where], 0)
        return total

    def best(self, terms: np.ndarray, best: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that score at least ``least`` and can be among the ``best`` of the block, ties included, with scores."""
        terms = terms[self.ends[terms] > self.begins[terms]]
        if not len(terms):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        _, tops, of = self.masks(terms)
        members = np.flatnonzero(of >= 0)
        members = members[np.argsort(-tops[of[members]], kind="stable")]
        bounds = tops[of[members]]
        found, scored, at, step = [], np.empty(0, np.int64), 0, 2 * best
        while at < len(members) and bounds[at] >= least:
            # Whole masks at a time: as many as make a step, or the one that is larger.
            end = int(np.searchsorted(-bounds, -bounds[at + step], side="left")) if at + step < len(members) else len(members)
            if end <= at:
                end = int(np.searchsorted(-bounds, -bounds[at], side="right"))
            found.append(members[at:end])
            scored = np.concatenate([scored, self.scores(terms, members[at:end])])
            if len(scored) >= best:
                least = max(least, int(np.partition(scored, len(scored) - best)[len(scored) - best]))
            at, step = end, 2 * step
        documents = np.concatenate(found) if found else np.empty(0, np.int64)
        kept = scored >= least
        return documents[kept], scored[kept]


def _ranked(index: DataFrame, pack: tuple, best: int, least: np.ndarray, documents: int, words: int, weights: np.ndarray, vocabulary: np.ndarray, id_type: T.DataType) -> DataFrame:
    """(item, key, score) of all documents that can be among the best of an item of the pack: its best in every block."""
    spark = index.sparkSession
    sent = spark.sparkContext.broadcast((pack, least, weights, vocabulary))
    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("key", id_type), T.StructField("score", T.LongType())])
    kinds = (("lengths", np.int32), ("terms", np.uint64), ("ends", np.int32), ("places", np.int32), ("counts", np.int32))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (ends, terms), floor, weight, known = sent.value
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: np.frombuffer(batch.column(j + 1)[k].as_buffer(), kind) for j, (name, kind) in enumerate(kinds)}
                keys, block = batch.column(0)[k].values, Block(row, known, weight, documents, words)
                items, places, scores, begin = [], [], [], 0
                for item, end in enumerate(ends.tolist()):
                    who, points = block.best(terms[begin:end], best, int(floor[item]))
                    begin = end
                    if len(who) > best:
                        ids = keys.take(pa.array(who))
                        order = pc.sort_indices(
                            pa.table({"s": points, "k": ids}), sort_keys=[("s", "descending"), ("k", "ascending")]
                        ).to_numpy()[:best]
                        who, points = who[order], points[order]
                    items.append(np.full(len(who), item, np.int32))
                    places.append(who)
                    scores.append(points)
                if items:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(items)), keys.take(pa.array(np.concatenate(places))), pa.array(np.concatenate(scores))], names=schema.names
                    )

    return index.select("keys", *[name for name, _ in kinds]).mapInArrow(run, schema)


def _top(rows: DataFrame, best: int) -> DataFrame:
    """The best of each item; Spark cuts to the first ranks in every input task before the shuffle."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def ranked_search(
    df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    best: int = BEST, block_words: int = BLOCK_WORDS, item_terms: int = ITEM_TERMS, probed: int = PROBED,
) -> DataFrame:
    """(item_id, rank, key, score): the ``best`` documents of each item with a score above 0, equal scores by ascending key.

    Terms are runs of ASCII letters, digits and characters beyond ASCII, A to Z lower-cased. A term of weight w that stands
    tf times in a document adds ``w * (1000000000 * tf div (1000 * tf + 20 * m))``, with m from the document's length;
    w is floor(1000 ln((2 N + 2) / (2 df + 1))). Whole texts count; documents without terms, null and empty ones among them,
    are none of the N. Items without terms give no rows. Repeated rows, and items or documents with equal or null ids, each
    stand for themselves; null keys rank last among equal scores. Other columns of either table are not read.

    The index is written once. Items run over it in packs of at most ``item_terms`` terms (or one item), which are all that
    is broadcast. One block in ``probed`` is searched first: the last score of an item there is a lower bound of its
    last score anywhere, so every other block returns only what reaches it.
    """
    spark = df.sparkSession
    index = written(index_blocks(df, key, text, block_words), "index")
    totals = index.agg(F.sum("documents").alias("documents"), F.sum("words").alias("words")).first()
    documents, words = totals["documents"] or 0, totals["words"] or 0
    packs = written(packed_items(items, item_id, item_text, item_terms), "items")
    id_type, key_type = packs.schema["items"].dataType.elementType, index.schema["keys"].dataType.elementType
    schema = T.StructType([
        T.StructField("item_id", id_type), T.StructField("rank", T.IntegerType()), T.StructField(key, key_type), T.StructField("score", T.LongType())
    ])
    result = None
    for row in packs.toLocalIterator():
        ends, terms = np.frombuffer(row["ends"], np.int32), np.frombuffer(row["terms"], np.uint64)
        vocabulary, places = np.unique(terms, return_inverse=True)
        holders = _holders(index, vocabulary)
        weights = np.array([term_weight(documents, holders[k]) if k in holders else 0 for k in range(len(vocabulary))], np.int64)
        pack, least = (ends, places.astype(np.int64)), np.ones(len(ends), np.int64)
        arguments = (documents, words, weights, vocabulary, key_type)
        probe = _top(_ranked(index.where(F.col("probe") % probed == 0), pack, best, least, *arguments), best).where(F.col("rank") == best)
        for known in probe.select("item", "score").collect():
            least[known["item"]] = max(1, known["score"])
        ranked = _top(_ranked(index, pack, best, least, *arguments), best)
        names = spark.createDataFrame(
            list(enumerate(row["items"])), T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", id_type)])
        )
        part = written(ranked.join(F.broadcast(names), "item").select("item_id", "rank", F.col("key").alias(key), "score"), "ranked")
        result = part if result is None else result.unionByName(part)
    return result if result is not None else spark.createDataFrame([], schema)
