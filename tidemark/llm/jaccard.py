"""Exact join of documents whose sets of word runs have a Jaccard similarity of at least ``PERCENT`` percent.

Rare runs come first in the order of every set, so a document's prefix holds its rarest runs. Two similar documents share a
run within their prefixes; a run that no other document has cannot be shared and is left out of the index.

1. Documents are dealt into blocks. A block sends each of its distinct runs once, with the number of its documents that
   have it, to the run's bucket; the bucket adds up and answers each block with frequency classes, of runs found more than
   once alone. A run that a third of all documents have so takes one entry of each block.
2. Each document keeps the prefix runs that others have. Documents with equal sets are one class, and its smallest id takes
   part for all of them.
3. Candidates share a prefix run and pass the length and the position filter; the suffix filter and the exact
   intersection judge each pair once. In a group of documents that share a run, pairs with one member, the pivot, are judged
   first. What they link need not be compared again: only groups that still hold several components go on, with other
   pivots, and at last with all pairs across components. The components are those of all links.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import buffer_of, column, hot_join, hot_keys
from tidemark.llm.words import SPACED, mixed, shingle_hashes, slices, word_bounds, word_hashes
from tidemark.session import written

#: Words of a run and least similarity in percent.
RUN, PERCENT = 5, 80
#: Documents of a block, least number of blocks, and blocks that one bucket of runs serves.
BLOCK_DOCUMENTS, LEAST_BLOCKS, BLOCKS_PER_BUCKET = 2_000, 48, 3

_LOW = np.uint64(0xFFFFFFFF)
_HALF = np.uint64(32)


def document_runs(batch_column: pa.Array, run: int) -> list[np.ndarray]:
    """Sorted distinct run hashes of each text of a column."""
    offsets, data = buffer_of(batch_column)
    found: list[np.ndarray] = []
    for a, b in slices(offsets):
        part = offsets[a : b + 1]
        starts, ends, firsts = word_bounds(data, part, SPACED)
        found += shingle_hashes(word_hashes(data, int(part[0]), starts, ends), firsts, run)
    return found


def _places(runs: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the upper half, short key in the lower half."""
    return (((runs >> _HALF) * np.uint64(buckets)) & ~_LOW) | (runs & _LOW)


def _texts(table: pa.Table, name: str) -> pa.Array:
    held = table.column(name).cast(pa.large_string()).combine_chunks()
    return held.combine_chunks() if isinstance(held, pa.ChunkedArray) else held


def _frequency_classes(blocks: DataFrame, buckets: int, run: int) -> DataFrame:
    """(block, bucket, classes): for the sorted distinct keys of a block in a bucket the bit length of their count, 0 for 1."""

    def send(table: pa.Table) -> pa.Table:
        runs = document_runs(_texts(table, "text"), run)
        places = np.sort(_places(np.concatenate(runs), buckets)) if runs else np.empty(0, np.uint64)
        starts = np.flatnonzero(np.concatenate(([True], places[1:] != places[:-1]))) if len(places) else np.empty(0, int)
        counts = np.diff(starts, append=len(places)).astype(np.uint32)
        places = places[starts]
        of = (places >> _HALF).astype(np.int64)
        cuts = np.searchsorted(of, np.arange(buckets + 1))
        filled = np.flatnonzero(np.diff(cuts))
        keys = (places & _LOW).astype(np.uint32)
        return pa.table({
            "block": pa.array(np.full(len(filled), table.column("block")[0].as_py()), pa.int32()),
            "bucket": pa.array(filled, pa.int32()),
            "keys": pa.array([keys[cuts[k] : cuts[k + 1]].tobytes() for k in filled], pa.binary()),
            "counts": pa.array([counts[cuts[k] : cuts[k + 1]].tobytes() for k in filled], pa.binary()),
        })

    def answer(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(v.as_py(), np.uint32) for v in table.column("keys")]
        counts = [np.frombuffer(v.as_py(), np.uint32) for v in table.column("counts")]
        # A key with its count in one number: sorting brings the entries of a key together.
        both = np.sort((np.concatenate(keys).astype(np.uint64) << _HALF) | np.concatenate(counts))
        starts = np.flatnonzero(np.concatenate(([True], (both[1:] >> _HALF) != (both[:-1] >> _HALF))))
        totals = np.add.reduceat((both & _LOW).astype(np.int64), starts)
        shared = totals > 1
        known = (both[starts[shared]] >> _HALF).astype(np.uint32)
        classes = np.ceil(np.log2(totals[shared] + 1)).astype(np.uint8)
        rows = []
        for block, own in zip(table.column("block").to_pylist(), keys):
            if len(known):
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                found = np.where(known[at] == own, classes[at], 0).astype(np.uint8)
                if found.any():
                    rows.append((block, found.tobytes()))
        bucket = table.column("bucket")[0].as_py()
        return pa.table({
            "block": pa.array([r[0] for r in rows], pa.int32()), "bucket": pa.array([bucket] * len(rows), pa.int32()),
            "classes": pa.array([r[1] for r in rows], pa.binary()),
        })

    sent = blocks.groupBy("block").applyInArrow(send, "block int, bucket int, keys binary, counts binary")
    return sent.groupBy("bucket").applyInArrow(answer, "block int, bucket int, classes binary")


def _prefixes(blocks: DataFrame, classes: DataFrame, buckets: int, run: int, percent: int) -> DataFrame:
    """One row per document: size and hash of its set; where others share prefix runs, these, their places and the set."""

    def keep(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({name: pa.array([], kind) for name, kind in kinds})
        runs = document_runs(_texts(table, "text"), run)
        every = _places(np.concatenate(runs), buckets)
        places = np.unique(every)
        rank = np.zeros(len(places), np.uint8)
        cuts = np.searchsorted((places >> _HALF).astype(np.int64), np.arange(buckets + 1))
        for bucket, found in zip(answers.column("bucket").to_pylist(), answers.column("classes")):
            rank[cuts[bucket] : cuts[bucket + 1]] = np.frombuffer(found.as_py(), np.uint8)
        rank = rank[np.searchsorted(places, every)]
        out = {name: [] for name, _ in kinds}
        first = 0
        for own in runs:
            n = len(own)
            held, first = rank[first : first + n], first + n
            prefix = n - (percent * n + 99) // 100 + 1
            alone = n - int(np.count_nonzero(held))
            out["n"].append(n)
            out["set1"].append(int(mixed(own).sum().astype(np.int64)) if n else 0)
            out["set2"].append(int(mixed(own ^ np.uint64(0x5851F42D4C957F2D)).sum().astype(np.int64)) if n else 0)
            if n and alone < prefix:
                order = np.argsort(held, kind="stable")[alone:prefix]
                out["grams"].append(own[order].view(np.int64))
                out["places"].append(np.arange(alone, alone + len(order), dtype=np.int32))
                out["members"].append(own.tobytes())
            else:
                for name in ("grams", "places", "members"):
                    out[name].append(None)
        out["doc"] = table.column("doc").to_pylist()
        return pa.table({name: pa.array(out[name], kind) for name, kind in kinds})

    kinds = [("doc", pa.int64()), ("n", pa.int64()), ("set1", pa.int64()), ("set2", pa.int64()), ("grams", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())), ("members", pa.binary())]
    schema = "doc bigint, n bigint, set1 bigint, set2 bigint, grams array<bigint>, places array<int>, members binary"
    return blocks.groupBy("block").cogroup(classes.groupBy("block")).applyInArrow(keep, schema)


def least_overlap(one: Column, other: Column, percent: int) -> Column:
    """Members that two sets of these sizes must share."""
    return F.ceil(percent * (one + other) / F.lit(100 + percent))


def similar(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar enough: the suffix filter, then the exact intersection."""
    need = -(-percent * (len(one) + len(other)) // (100 + percent))
    if min(len(one), len(other)) < need:
        return False
    probes = one[[len(one) // 4, len(one) // 2, 3 * len(one) // 4]]
    ours = np.diff(np.concatenate(([0], np.searchsorted(one, probes), [len(one)])))
    theirs = np.diff(np.concatenate(([0], np.searchsorted(other, probes), [len(other)])))
    if np.minimum(ours, theirs).sum() < need:
        return False
    at = np.minimum(np.searchsorted(other, one), len(other) - 1)
    shared = int(np.count_nonzero(other[at] == one))
    return 100 * shared >= percent * (len(one) + len(other) - shared)


def _judged(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar. ``b`` may stand in very many pairs, so its copies are dealt over tasks."""
    left = pairs.join(sets.select(F.col("doc").alias("a"), F.col("members").alias("one")), "a")
    counted = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    total = pairs.count()
    both = hot_join(left, sets.select(F.col("doc").alias("b"), F.col("members").alias("other")), "b", hot_keys(counted, "b", "n", total, 200), "a")

    def judge(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            ones, others = (batch.column(k) for k in (2, 3))
            same = pa.array([similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in zip(ones, others)], pa.bool_())
            yield batch.select(["a", "b"]).filter(same)

    return both.select("a", "b", "one", "other").mapInArrow(judge, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of undirected ``edges`` (a, b); a component bears its smallest node.

    Each round hangs every node below its smallest neighbour, follows that once more and contracts the edges, so at least half
    of the nodes that still have edges go. Rounds are written to the shared folder.
    """
    edges = written(edges.where("a <> b").distinct(), "edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = written(nodes.withColumn("component", F.col("node")), "labels")
    while edges.take(1):
        both = edges.union(edges.select("b", "a"))
        below = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        below = below.select("node", F.least("node", "low").alias("up"))
        further = below.select(F.col("node").alias("up"), F.col("up").alias("top"))
        below = written(below.join(further, "up", "left").select("node", F.least("up", F.coalesce("top", "up")).alias("top")), "parents")
        step = lambda name: below.select(F.col("node").alias(name), F.col("top").alias(f"_{name}"))
        labels = written(labels.join(step("component"), "component", "left").select("node", F.coalesce("_component", "component").alias("component")), "labels")
        edges = edges.join(step("a"), "a", "left").join(step("b"), "b", "left")
        edges = edges.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
        edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return labels


def _fits(percent: int) -> Column:
    """Length and position filter of a pair that shares a run at ``place`` and ``other_place``."""
    rest = F.least(F.col("n") - F.col("place"), F.col("other_n") - F.col("other_place"))
    return (100 * F.least("n", "other_n") >= percent * F.greatest("n", "other_n")) & (rest >= least_overlap(F.col("n"), F.col("other_n"), percent))


def link(index: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, component) of the documents in ``index`` (gram, doc, n, place) that have a link."""
    edges, labels, turn, before = None, None, 0, None
    while True:
        if labels is None:
            rows = index.withColumn("component", F.col("doc"))
        else:
            rows = index.join(labels.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
        parts = rows.groupBy("gram", "component").agg(F.count(F.lit(1)).alias("k"))
        open_grams = parts.groupBy("gram").agg(F.sum("k").alias("rows"), F.sum(F.col("k") * F.col("k")).alias("squares"), F.count(F.lit(1)).alias("held")).where("held > 1")
        open_grams = written(open_grams, "open")
        left = open_grams.agg(F.sum("rows"), F.sum((F.col("rows") * F.col("rows") - F.col("squares")) / 2), F.count(F.lit(1))).first()
        if not left[2]:
            break
        hot = hot_keys(open_grams, "gram", "rows", left[0])
        rows = written(hot_join(rows, open_grams.select("gram"), "gram", hot, "doc"), "index")
        few = left[1] <= 4 * left[0] or (before is not None and left[1] > 0.7 * before)
        before = left[1]
        mark = F.xxhash64("doc", F.lit(turn)) if turn else F.col("doc")
        if few:
            other = rows.select("gram", F.col("doc").alias("other"), F.col("n").alias("other_n"), F.col("place").alias("other_place"), F.col("component").alias("other_component"))
            met = hot_join(rows, other, "gram", hot, "doc").where("doc > other")
        else:
            pivots = rows.groupBy("gram").agg(F.min(F.struct(mark.alias("mark"), F.col("doc").alias("other"), F.col("n").alias("other_n"), F.col("place").alias("other_place"), F.col("component").alias("other_component"))).alias("p")).select("gram", "p.*")
            met = hot_join(rows, pivots, "gram", hot, "doc")
        pairs = met.where(F.col("component") != F.col("other_component")).where(_fits(percent))
        pairs = written(pairs.select(F.col("doc").alias("a"), F.col("other").alias("b")).distinct(), "pairs")
        found = _judged(pairs, sets, percent)
        edges = written(found if edges is None else edges.union(found), "links")
        labels = components(edges)
        if few:
            break
        index, turn = rows.drop("component"), turn + 1
    return labels


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", run: int = RUN, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id) for each row; ``component_id`` is the smallest id that links reach, itself included.

    Words are runs between white space with A to Z lower-cased; a text of fewer than ``run`` words is one run, a null or empty
    one has none and links with nothing. Rows with a null key have no component and link with nothing; rows that repeat a
    key are one document as to links and keep a row each. Similarity is exact on 64-bit hashes of the runs. Only
    ``key``, a whole number, and ``text`` are read, whatever else ``df`` has.
    """
    rows = df.select(column(key).cast("long").alias("doc"), F.coalesce(column(text), F.lit("")).alias("text"))
    blocks = max(LEAST_BLOCKS, -(-df.count() // BLOCK_DOCUMENTS))
    buckets = max(LEAST_BLOCKS // 2, blocks // BLOCKS_PER_BUCKET)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc", F.when(F.col("doc").isNull(), F.xxhash64("text"))), F.lit(blocks)).cast("int"))
    every = written(_prefixes(dealt, _frequency_classes(dealt, buckets, run), buckets, run, percent), "sets")
    known = every.where(F.col("doc").isNotNull() & (F.col("n") > 0))
    name = F.xxhash64("set1", "set2", "n")
    classes = written(known.groupBy("set1", "set2", "n").agg(F.min("doc").alias("head"), F.count(F.lit(1)).alias("k")).withColumn("class", name), "classes")
    heads = classes.select(F.col("head").alias("doc"), "set1", "set2")
    sets = known.where(F.col("members").isNotNull()).join(heads, ["doc", "set1", "set2"]).dropDuplicates(["doc", "set1"])
    sets = written(sets.select("doc", "n", "grams", "places", "members"), "heads")
    index = sets.select("doc", "n", F.explode(F.arrays_zip("grams", "places")).alias("z")).select(F.col("z.grams").alias("gram"), "doc", "n", F.col("z.places").alias("place"))
    labels = link(written(index, "index"), sets.select("doc", "members"), percent)
    total = known.count()
    marked = every.withColumn("class", F.when(F.col("doc").isNotNull() & (F.col("n") > 0), name)).select("doc", "n", "class")
    lookup = classes.select("class", "head")
    if labels is not None:
        lookup = lookup.join(labels.select(F.col("node").alias("head"), "component"), "head", "left").select("class", F.coalesce("component", "head").alias("head"))
    member = hot_join(marked, lookup, "class", hot_keys(classes, "class", "k", total), "doc", "left")
    return member.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.coalesce("head", "doc").alias("component_id"))


#: Ids that may be sent to every task; 16 bytes each.
MOST_SENT = 1_000_000


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", run: int = RUN, percent: int = PERCENT) -> DataFrame:
    """``df`` with one document of each group that links connect, the one with the smallest id.

    Rows with a null key stay, and so do texts without words; of rows that repeat a key one stays.
    """
    groups = near_duplicates(df, key, text, run, percent)
    gone = written(groups.where(F.col("component_id") < F.col(key)).select(key).distinct(), "gone")
    if gone.count() <= MOST_SENT:
        gone = F.broadcast(gone)
    kept = df.join(gone, key, "left_anti").select(*[column(c) for c in df.columns])
    if groups.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").take(1):
        kept = kept.where(column(key).isNotNull()).dropDuplicates([key]).unionByName(kept.where(column(key).isNull()))
    return kept
