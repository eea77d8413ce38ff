"""Passages that repeat across documents, exactly or with small changes, by collinear chaining of shared seeds.

1. Seeds are all runs of ``SEED`` words of texts that are long enough. A block of documents sends the key of each distinct
   seed once; the seed's bucket answers which ones several documents have. For these alone the block then sends the first
   place where it has them, and the bucket answers with the first place of all. A seed that a third of all documents have
   thus takes one entry of each block.
2. In each document the seeds that first stand in one other document are points (place here, place there); of neighbouring
   ones every ``SEED``-th and the last stay. Ordered points are chained for the best score, where gaps cost in proportion
   to the words skipped in both texts; the best chain up to each point comes from a Fenwick tree of prefix maxima over the
   places there.
3. Where a run of ``LEAST`` words may stand whole elsewhere, but its seeds first stand at several places, that nine tenths of it
   whose hash is least is a key itself. Its first holder has it whole, so every exact passage is found, however its parts
   are spread over earlier documents; neighbouring runs mostly choose the same part.
4. A chain is aligned word by word, through its gaps and beyond its ends, and reported if the passage has at least
   ``LEAST`` words here and there of which ``PERCENT`` percent match. Up to here only places travel; words are read again
   for the documents that a chain names, and for no others.

Of passages of the same two documents that overlap, as many are reported as it takes to cover their words. A passage is
linked to its first holder, so the report grows with the number of holders, not of their pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import buffer_of, column, hot_join, hot_keys, in_slices
from tidemark.llm.words import SPACED, mixed, slices, word_bounds, word_hashes
from tidemark.operators.skew import bounded
from tidemark.session import written

SEED, LEAST, PERCENT = 5, 50, 80
#: Cost of a skipped word in units of a matching one, longest gap in a chain, words looked at beyond its ends.
GAP_COST, MOST_GAP, MARGIN = 0.1, 60, 64
BLOCK_DOCUMENTS, LEAST_BLOCKS, BLOCKS_PER_BUCKET = 2_000, 48, 3

_LOW, _HALF = np.uint64(0xFFFFFFFF), np.uint64(32)


def documents_words(batch_column: pa.Array) -> list[np.ndarray]:
    """Word hashes of each text of a column."""
    offsets, data = buffer_of(batch_column)
    found: list[np.ndarray] = []
    for a, b in slices(offsets):
        part = offsets[a : b + 1]
        starts, ends, firsts = word_bounds(data, part, SPACED)
        hashes = word_hashes(data, int(part[0]), starts, ends)
        found += [hashes[x:y] for x, y in zip(firsts[:-1].tolist(), firsts[1:].tolist())]
    return found


def seed_hashes(words: np.ndarray) -> np.ndarray:
    """Hash of the run of ``SEED`` words at each place of consecutive texts; runs over a border are among them."""
    n = max(0, len(words) - SEED + 1)
    runs = np.zeros(n, np.uint64)
    for k in range(SEED):
        runs = runs * np.uint64(0xD1342543DE82EF95) + words[k : n + k]
    return mixed(runs + np.uint64(SEED))


def _planes(values: np.ndarray, half: str) -> bytes:
    """Low halves of all values, then the high ones, which are mostly alike and pack well."""
    return np.ascontiguousarray(values).view(half).reshape(-1, 2).T.tobytes()


def _from_planes(data: bytes, half: str, whole: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, half).reshape(2, -1).T).view(whole).ravel()


def _steps(keys: np.ndarray) -> bytes:
    """Ascending keys as the steps between them, byte by byte of equal worth, so that the high ones, mostly zero, pack away."""
    return np.ascontiguousarray(np.diff(keys, prepend=np.uint32(0))).view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_steps(data: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
    return np.cumsum(steps, dtype=np.uint32)


def _text(table: pa.Table) -> pa.Array:
    held = table.column("text").cast(pa.large_string()).combine_chunks()
    return held.combine_chunks() if isinstance(held, pa.ChunkedArray) else held


class _Block:
    """The documents of a block by id, and their seeds by bucket and key, document and place.

    ``target`` holds the bucket in the upper half and the key in the lower one, ``spot`` the seed's place in the texts
    set end to end, ``starts`` the first seed of each distinct key and ``cuts`` the first distinct key of each bucket.
    """

    def __init__(self, table: pa.Table, buckets: int, least: int):
        ids, words = np.array(table.column("doc").to_pylist(), np.int64), documents_words(_text(table))
        order = np.argsort(ids, kind="stable")
        self.ids, self.words = ids[order], [words[k] for k in order.tolist()]
        sizes = np.array([len(w) for w in self.words], np.int64)
        self.first = np.cumsum(sizes) - sizes
        self.every = np.concatenate(self.words) if self.words else np.empty(0, np.uint64)
        self.row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        runs = seed_hashes(self.every)
        row = self.row[: len(runs)]
        # Runs that end in the next text are none; a text with too few words can neither hold nor repeat a passage.
        inside = (np.arange(len(runs)) + SEED <= (self.first + sizes)[row]) & (sizes[row] >= least)
        spot = np.flatnonzero(inside)
        runs = runs[spot]
        target = (((runs >> _HALF) * np.uint64(buckets)) & ~_LOW) | (runs & _LOW)
        order = np.argsort(target, kind="stable")
        self.target, self.spot = target[order], spot[order]
        self.new = np.concatenate(([True], self.target[1:] != self.target[:-1])) if len(spot) else np.empty(0, bool)
        self.starts = np.flatnonzero(self.new)
        self.cuts = np.searchsorted((self.target[self.starts] >> _HALF).astype(np.int64), np.arange(buckets + 1))

    def shared(self, answers: pa.Table) -> np.ndarray:
        """Which of the distinct keys several documents have."""
        found = np.zeros(len(self.starts), bool)
        for bucket, bits in zip(answers.column("bucket").to_pylist(), answers.column("shared")):
            a, b = self.cuts[bucket], self.cuts[bucket + 1]
            found[a:b] = np.unpackbits(np.frombuffer(bits.as_py(), np.uint8))[: b - a]
        return found


def _shared_keys(blocks: DataFrame, buckets: int, least: int) -> DataFrame:
    """(block, bucket, shared): which of the block's sorted distinct keys several documents have."""

    def send(table: pa.Table) -> pa.Table:
        block = _Block(table, buckets, least)
        keys = (block.target[block.starts] & _LOW).astype(np.uint32)
        ends = np.append(block.starts[1:], len(block.spot)) - 1
        # Seeds of a key are in the order of their documents.
        several = block.ids[block.row[block.spot[block.starts]]] != block.ids[block.row[block.spot[ends]]] if len(keys) else np.empty(0, bool)
        cuts = block.cuts
        filled = np.flatnonzero(np.diff(cuts))
        return pa.table({
            "block": pa.array(np.full(len(filled), table.column("block")[0].as_py()), pa.int32()), "bucket": pa.array(filled, pa.int32()),
            "keys": pa.array([_steps(keys[cuts[k] : cuts[k + 1]]) for k in filled], pa.binary()),
            "several": pa.array([np.packbits(several[cuts[k] : cuts[k + 1]]).tobytes() for k in filled], pa.binary()),
        })

    def answer(table: pa.Table) -> pa.Table:
        keys = [_from_steps(v.as_py()) for v in table.column("keys")]
        several = [np.unpackbits(np.frombuffer(v.as_py(), np.uint8))[: len(own)] for v, own in zip(table.column("several"), keys)]
        # A key and its mark in one number: sorting brings the entries of a key together.
        both = np.sort((np.concatenate(keys).astype(np.uint64) << _HALF) | np.concatenate(several))
        found = (both >> _HALF).astype(np.uint32)
        starts = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
        shared = (np.diff(starts, append=len(both)) > 1) | ((both[starts] & _LOW) > 0)
        known = found[starts[shared]]
        rows = []
        for block, own in zip(table.column("block").to_pylist(), keys):
            if len(known):
                same = known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own
                if same.any():
                    rows.append((block, np.packbits(same).tobytes()))
        bucket = table.column("bucket")[0].as_py()
        return pa.table({
            "block": pa.array([r[0] for r in rows], pa.int32()), "bucket": pa.array([bucket] * len(rows), pa.int32()),
            "shared": pa.array([r[1] for r in rows], pa.binary()),
        })

    sent = blocks.groupBy("block").applyInArrow(send, "block int, bucket int, keys binary, several binary")
    return sent.groupBy("bucket").applyInArrow(answer, "block int, bucket int, shared binary")


def _first_places(blocks: DataFrame, shared: DataFrame, buckets: int, least: int) -> DataFrame:
    """(block, bucket, shared, docs, places): the shared keys of a block and where each first stands."""
    kinds = [("block", pa.int32()), ("bucket", pa.int32()), ("shared", pa.binary()), ("keys", pa.binary()), ("docs", pa.binary()), ("places", pa.binary())]

    def send(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        if table.num_rows and answers.num_rows:
            block = _Block(table, buckets, least)
            held = block.shared(answers)
            before = np.concatenate(([0], np.cumsum(held)))
            starts = block.starts[held]
            keys, spot = (block.target[starts] & _LOW).astype(np.uint32), block.spot[starts]
            row = block.row[spot]
            docs, places = block.ids[row], (spot - block.first[row]).astype(np.uint32)
            for bucket, bits in zip(answers.column("bucket").to_pylist(), answers.column("shared").to_pylist()):
                a, b = before[block.cuts[bucket]], before[block.cuts[bucket + 1]]
                rows.append((key[0].as_py(), bucket, bits, _steps(keys[a:b]), _planes(docs[a:b], "<u4"), _planes(places[a:b], "<u2")))
        return pa.table({name: pa.array([r[c] for r in rows], kind) for c, (name, kind) in enumerate(kinds)})

    def answer(table: pa.Table) -> pa.Table:
        lists = [_from_steps(v.as_py()) for v in table.column("keys")]
        keys = np.concatenate(lists)
        docs = np.concatenate([_from_planes(v.as_py(), "<u4", "<i8") for v in table.column("docs")])
        places = np.concatenate([_from_planes(v.as_py(), "<u2", "<u4") for v in table.column("places")])
        order = np.lexsort((places, docs, keys))
        keys, docs, places = keys[order], docs[order], places[order]
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        keys, docs, places = keys[starts], docs[starts], places[starts]
        at = [np.searchsorted(keys, own) for own in lists]
        return pa.table({
            "block": table.column("block"), "bucket": table.column("bucket"), "shared": table.column("shared"),
            "docs": pa.array([_planes(docs[k], "<u4") for k in at], pa.binary()), "places": pa.array([_planes(places[k], "<u2") for k in at], pa.binary()),
        })

    sent = blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(send, "block int, bucket int, shared binary, keys binary, docs binary, places binary")
    return sent.groupBy("bucket").applyInArrow(answer, "block int, bucket int, shared binary, docs binary, places binary")


class PrefixMaxima:
    """A Fenwick tree: the best (score, point) among the first places."""

    def __init__(self, size: int):
        self.best: list[tuple[float, int]] = [(float("-inf"), -1)] * (size + 1)

    def put(self, place: int, score: float, point: int) -> None:
        place += 1
        while place < len(self.best):
            if self.best[place][0] < score:
                self.best[place] = (score, point)
            place += place & -place

    def before(self, place: int) -> tuple[float, int]:
        """The best among places below ``place``."""
        found = (float("-inf"), -1)
        while place > 0:
            if self.best[place][0] > found[0]:
                found = self.best[place]
            place -= place & -place
        return found


def thinned(row: np.ndarray, other: np.ndarray, here: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Which points to keep: of each run of neighbouring ones, every ``SEED``-th and the last, so that points score what they cover.

    Points are in the order of their document, the other document and the place here.
    """
    if not len(row):
        return np.empty(0, bool)
    follows = (row[1:] == row[:-1]) & (other[1:] == other[:-1]) & (here[1:] == here[:-1] + 1) & (there[1:] == there[:-1] + 1)
    starts = np.flatnonzero(np.concatenate(([True], ~follows)))
    along = np.arange(len(row)) - np.repeat(starts, np.diff(starts, append=len(row)))
    return (along % SEED == 0) | np.concatenate((~follows, [True]))


def chains(here: list[int], there: list[int]) -> list[list[int]]:
    """Best chains of points that increase in both texts; each point is in one chain at most.

    ``here`` increases. Of several points with one place there, the later ones start chains of their own.
    """
    ranks = {place: k for k, place in enumerate(sorted(set(there)))}
    tree = PrefixMaxima(len(ranks))
    score, back = [0.0] * len(here), [-1] * len(here)
    for point, (x, y) in enumerate(zip(here, there)):
        best, before = tree.before(ranks[y])
        gap = GAP_COST * (x + y) / 2
        score[point] = float(SEED)
        if before >= 0 and best - gap > 0:
            score[point] += best - gap
            back[point] = before
        tree.put(ranks[y], score[point] + gap, point)
    taken, found = [False] * len(here), []
    for point in sorted(range(len(here)), key=lambda p: (-score[p], p)):
        path = []
        while point >= 0 and not taken[point]:
            taken[point] = True
            path.append(point)
            after = back[point]
            if after >= 0 and max(here[point] - here[after], there[point] - there[after]) > MOST_GAP:
                found.append(path[::-1])
                path = []
            point = after
        if path:
            found.append(path[::-1])
    return [path for path in found if len(path) > 1]


def without_parts(paths: list[tuple], least: int, percent: int) -> list[tuple]:
    """Chains (other, here, there) of a document without the short ones that lie within a passage of an earlier holder.

    Copies of a passage that share a change have the few seeds over it in common; the passage around it is reported with
    its first holder. Only a chain whose seeds alone make it a passage counts as one here.
    """
    sure = []
    for other, here, there in paths:
        span, other_span = here[-1] + SEED - here[0], there[-1] + SEED - there[0]
        if min(span, other_span) >= least:
            covered = SEED + sum(min(x - w, y - z, SEED) for w, x, z, y in zip(here, here[1:], there, there[1:]))
            if 100 * covered >= percent * max(span, other_span):
                sure.append((here[0], here[-1], other))
    if not sure:
        return paths
    kept = []
    for path in paths:
        other, here, _ = path
        if here[-1] + SEED - here[0] >= least or not any(a <= here[0] and here[-1] <= b and first < other for a, b, first in sure):
            kept.append(path)
    return kept


def _stretch(one: np.ndarray, other: np.ndarray) -> tuple[int, int, int]:
    """How far two texts go together from their begins: words of each and matching ones, past single changes."""
    x = y = matching = 0
    best = (0, 0, 0)
    while x < len(one) and y < len(other):
        size = min(len(one) - x, len(other) - y)
        differ = np.flatnonzero(one[x : x + size] != other[y : y + size])
        equal = int(differ[0]) if len(differ) else size
        x, y, matching = x + equal, y + equal, matching + equal
        best = (x, y, matching)
        for dx, dy in ((1, 1), (1, 0), (0, 1), (2, 2), (2, 1), (1, 2)):
            a, b = one[x + dx : x + dx + 4], other[y + dy : y + dy + 4]
            if len(a) == 4 == len(b) and (a == b).all():
                x, y = x + dx, y + dy
                break
        else:
            break
    return best


def _equal(one: np.ndarray, other: np.ndarray) -> tuple[int, int, int]:
    """``_stretch`` up to the first change."""
    size = min(len(one), len(other))
    differ = np.flatnonzero(one[:size] != other[:size])
    equal = int(differ[0]) if len(differ) else size
    return equal, equal, equal


def _common(one: np.ndarray, other: np.ndarray) -> int:
    """Length of the longest common subsequence of two short stretches."""
    if len(one) == len(other):
        same = int((one == other).sum())
        if same == len(one):
            return same
    row = np.zeros(len(other) + 1, np.int64)
    for word in one:
        step = np.maximum(row[1:], np.where(other == word, row[:-1] + 1, 0))
        row[1:] = np.maximum.accumulate(step)
    return int(row[-1])


def aligned(own: np.ndarray, first: int, other: np.ndarray, here: list[int], there: list[int], least: int, percent: int) -> list[tuple[int, int, int, int, int]]:
    """Passages of a chain: start and end here, start and end there, matching words.

    ``own`` are the words around the chain, from place ``first`` on; ``other`` are all words of the other document. A chain
    in which too few words match is cut where most are missed, so that it hides no passage that it holds.
    """
    matching = [_common(own[here[k] - first : here[k + 1] - first], other[there[k] : there[k + 1]]) for k in range(len(here) - 1)]
    missed = [max(here[k + 1] - here[k], there[k + 1] - there[k]) - matching[k] for k in range(len(here) - 1)]
    found, parts = [], [(0, len(here) - 1)]
    while parts:
        a, b = parts.pop()
        end, other_end = here[b], there[b]
        one, two = own[end - first :], other[other_end : other_end + SEED + MARGIN]
        one_back, two_back = own[: here[a] - first][::-1], other[max(0, there[a] - MARGIN) : there[a]][::-1]
        for stretch in (_stretch, _equal):
            ahead, behind = stretch(one, two), stretch(one_back, two_back)
            start, stop, other_start, other_stop = here[a] - behind[0], end + ahead[0], there[a] - behind[1], other_end + ahead[1]
            same, size = sum(matching[a:b]) + ahead[2] + behind[2], max(stop - start, other_stop - other_start)
            if min(stop - start, other_stop - other_start) >= least and 100 * same >= percent * size:
                found.append((start, stop, other_start, other_stop, same))
                break
        else:
            worst = max(range(a, b), key=lambda k: missed[k], default=a)
            if b > a and missed[worst] > 0:
                parts += [(x, y) for x, y in ((a, worst), (worst + 1, b)) if x < y]
    return found


def covering(passages: list[tuple]) -> list[tuple]:
    """Fewest of the passages of two documents that together cover the same words here.

    A text that repeats itself matches one place at very many shifts.
    """
    kept: list[tuple] = []
    reach, best = -1, None
    for passage in sorted(passages, key=lambda p: (p[0], -p[1])):
        start, end = passage[:2]
        if best is not None and start > reach:
            kept.append(best)
            reach, best = best[1], None
        if start > reach:
            kept.append(passage)
            reach = end
        elif end > reach and (best is None or end > best[1]):
            best = passage
    return kept + ([best] if best is not None else [])


_CHAIN = [("other", pa.int64()), ("first", pa.int32()), ("words", pa.binary()), ("here", pa.list_(pa.int32())), ("there", pa.list_(pa.int32()))]


_WHOLE = [("run", pa.int64()), ("at", pa.list_(pa.int32()))]


def scattered(block: _Block, spot: np.ndarray, other: np.ndarray, there: np.ndarray, least: int) -> np.ndarray:
    """Places of runs of ``least`` words that others may have whole, but whose seeds first stand at several places.

    That depends on the words of the run alone, so all documents that have it find it.
    """
    span, n = max(1, least - SEED + 1), len(block.every)
    if n < span or not len(spot):
        return np.empty(0, np.int64)
    present, whose, where = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    present[spot], whose[spot], where[spot] = 1, other, there
    breaks = (whose[1:] != whose[:-1]) | (where[1:] != where[:-1] + 1)
    held, broken = np.concatenate(([0], np.cumsum(present))), np.concatenate(([0], np.cumsum(breaks)))
    return np.flatnonzero((held[span:] - held[:-span] == span) & (broken[span - 1 :] - broken[: n - span + 1] > 0))


def parts_of(words: np.ndarray, spots: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the parts that stand for the runs of ``least`` words at the places ``spots``: of all parts of
    ``part_size(least)`` words of a run the one with the least hash. That depends on the words of the run alone."""
    size = part_size(least)
    if not len(spots):
        return spots, np.empty(0, np.int64)
    best, place = run_hashes(words, spots, size), spots.copy()
    for k in range(1, least - size + 1):
        other = run_hashes(words, spots + k, size)
        less = other < best
        best[less], place[less] = other[less], spots[less] + k
    place, at = np.unique(place, return_index=True)
    return place, best[at]


def part_size(least: int) -> int:
    return least - least // 10


def run_hashes(words: np.ndarray, spots: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each of the places."""
    runs = np.zeros(len(spots), np.uint64)
    for k in range(size):
        runs = runs * np.uint64(0xD1342543DE82EF95) + words[spots + k]
    return mixed(runs + np.uint64(size)).view(np.int64)


def _words_of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc, words): the words of the documents with these ids, read from the texts once more. The ids are sent to the
    texts where they are few enough, by their count; else both meet in a shuffle."""
    wanted = bounded(written(ids.select("doc").distinct(), "named"), 16)

    def cut(batches):
        for batch in batches:
            for part in in_slices(batch, 1):
                words = [(own >> _HALF).astype(np.uint32).tobytes() for own in documents_words(part.column(1).cast(pa.large_string()))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words, pa.binary())], names=["doc", "words"])

    return rows.join(wanted, "doc", "left_semi").select("doc", "text").mapInArrow(cut, "doc bigint, words binary")


def _whole_runs(found: DataFrame, rows: DataFrame, least: int) -> DataFrame:
    """Links like those of chains: the scattered runs of each document to the first document that has them whole."""
    runs = found.where(F.col("whole").isNotNull()).select("doc", F.explode("whole").alias("w")).select("doc", "w.run", "w.at")
    counted = runs.groupBy("run").agg(F.min(F.struct("doc", F.col("at")[0].alias("place"))).alias("of"), F.count(F.lit(1)).alias("n")).where("n > 1")
    counted = written(counted.select("run", F.col("of.doc").alias("other"), F.col("of.place").alias("there"), "n"), "runs")
    total = counted.agg(F.sum("n")).first()[0]
    met = hot_join(runs, counted.select("run", "other", "there"), "run", hot_keys(counted, "run", "n", total or 0), "doc").where("doc <> other")
    points = met.select("doc", F.struct("other", "there", "at").alias("p")).groupBy("doc").agg(F.collect_list("p").alias("points"))
    points = written(points, "points")
    kinds = [("doc", pa.int64()), *_CHAIN]
    size = part_size(least)

    def cut(batches):
        for batch in batches:
            for row in pa.Table.from_batches([batch]).to_pylist():
                words, rows = np.frombuffer(row["words"], np.uint32), []
                places = sorted((p["other"], at - p["there"], at) for p in row["points"] for at in p["at"])
                exact: dict[int, list[tuple[int, int, int]]] = {}
                for other, shift, at in places:
                    own = exact.setdefault(other, [])
                    # Parts that meet or overlap at one shift are one stretch of equal words.
                    if own and own[-1][2] == shift and at <= own[-1][1]:
                        own[-1] = (own[-1][0], at + size, shift)
                    else:
                        own.append((at, at + size, shift))
                for other, passages in exact.items():
                    for start, stop, shift in covering(passages):
                        end, first = stop - SEED, max(0, start - MARGIN)
                        here = [*range(start, end, SEED), end]
                        rows.append((row["doc"], other, first, words[first : stop + MARGIN].tobytes(), here, [x - shift for x in here]))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, (_, kind) in enumerate(kinds)], names=[name for name, _ in kinds])

    texts = _words_of(rows, points)
    return texts.join(points, "doc").select("doc", "words", "points").mapInArrow(cut, "doc bigint, other bigint, first int, words binary, here array<int>, there array<int>")


def _chained(blocks: DataFrame, firsts: DataFrame, buckets: int, least: int, percent: int) -> DataFrame:
    """One row per document with chains or scattered runs."""
    kinds = [("doc", pa.int64()), ("chains", pa.list_(pa.struct(_CHAIN))), ("whole", pa.list_(pa.struct(_WHOLE)))]

    def run(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if table.num_rows and answers.num_rows:
            block = _Block(table, buckets, least)
            words, ids, row = block.words, block.ids, block.row[block.spot]
            at = block.spot - block.first[row]
            held = block.shared(answers)
            before = np.concatenate(([0], np.cumsum(held)))
            doc_of, place_of = np.zeros(before[-1], np.int64), np.zeros(before[-1], np.int64)
            for bucket, docs, places in zip(answers.column("bucket").to_pylist(), answers.column("docs"), answers.column("places")):
                part = slice(before[block.cuts[bucket]], before[block.cuts[bucket + 1]])
                doc_of[part], place_of[part] = _from_planes(docs.as_py(), "<u4", "<i8"), _from_planes(places.as_py(), "<u2", "<u4")
            entry = np.cumsum(block.new) - 1
            shared = np.flatnonzero(held[entry])
            there, other = place_of[before[entry[shared]]], doc_of[before[entry[shared]]]
            row, at = row[shared], at[shared]
            spots, keys = parts_of(block.every, scattered(block, block.spot[shared], other, there, least), least)
            # Rows of an id are in one block; one of them has its runs.
            held_by = np.unique(block.row[spots])
            lenders = set(held_by[np.unique(ids[held_by], return_index=True)[1]].tolist())
            whole: dict[int, list[dict]] = {}
            order = np.lexsort((spots, keys, block.row[spots]))
            spots, keys = spots[order], keys[order]
            mine = block.row[spots]
            edges = np.flatnonzero(np.concatenate(([True], (mine[1:] != mine[:-1]) | (keys[1:] != keys[:-1])))).tolist() if len(spots) else []
            for a, b in zip(edges, [*edges[1:], len(spots)]):
                if (k := int(mine[a])) in lenders:
                    whole.setdefault(k, []).append({"run": int(keys[a]), "at": (spots[a:b] - block.first[k]).tolist()})
            away = np.flatnonzero(other != ids[row])
            away = away[np.lexsort((at[away], other[away], row[away]))]
            away = away[thinned(row[away], other[away], at[away], there[away])]
            borders = np.flatnonzero(np.concatenate(([True], (row[away][1:] != row[away][:-1]) | (other[away][1:] != other[away][:-1])))) if len(away) else []
            linked: dict[int, list[dict]] = {}
            found: dict[int, list[tuple]] = {}
            for a, b in zip(borders, [*borders[1:], len(away)]):
                if b - a < 2:
                    continue
                group = away[a:b]
                mine, here, yonder = int(row[group[0]]), at[group].tolist(), there[group].tolist()
                for path in chains(here, yonder):
                    found.setdefault(mine, []).append((int(other[group[0]]), [here[p] for p in path], [yonder[p] for p in path]))
            for mine, paths in found.items():
                for whose, here, yonder in without_parts(paths, least, percent):
                    first = max(0, here[0] - MARGIN)
                    linked.setdefault(mine, []).append({
                        "other": whose, "first": first, "words": (words[mine][first : here[-1] + SEED + MARGIN] >> _HALF).astype(np.uint32).tobytes(),
                        "here": here, "there": yonder,
                    })
            for k in sorted({*whole, *linked}):
                rows.append((int(ids[k]), linked.get(k), whole.get(k)))
        return pa.table({name: pa.array([r[c] for r in rows], kind) for c, (name, kind) in enumerate(kinds)})

    chain = "array<struct<other:bigint,first:int,words:binary,here:array<int>,there:array<int>>>"
    return blocks.groupBy("block").cogroup(firsts.groupBy("block")).applyInArrow(run, f"doc bigint, chains {chain}, whole array<struct<run:bigint,at:array<int>>>")


def repeated_passages(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, percent: int = PERCENT) -> DataFrame:
    """One row per passage: (key, start_word, end_word, first_doc_id, first_start, first_end, n_matching).

    Words are runs between white space with A to Z lower-cased; ends are exclusive. The document with the smaller key
    holds the passage first and is reported only as such. Null and empty texts and texts of fewer than ``least`` words have
    no passage; rows with a null key take no part; rows that repeat a key count as one document of which any row's text
    may be the one compared. Only ``key``, a whole number, and ``text`` are read.
    """
    rows = df.select(column(key).cast("long").alias("doc"), column(text).alias("text")).where(F.col("doc").isNotNull() & F.col("text").isNotNull())
    blocks = max(LEAST_BLOCKS, -(-df.count() // BLOCK_DOCUMENTS))
    buckets = max(LEAST_BLOCKS // 2, blocks // BLOCKS_PER_BUCKET)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc"), F.lit(blocks)).cast("int"))
    firsts = _first_places(dealt, _shared_keys(dealt, buckets, least), buckets, least)
    found = written(_chained(dealt, firsts, buckets, least, percent), "chains")
    links = found.select("doc", F.explode("chains").alias("c")).select("doc", "c.*")
    links = links.unionByName(written(_whole_runs(found, rows, least), "whole"))
    holders = _words_of(rows, links.select(F.col("other").alias("doc"))).withColumnRenamed("doc", "other")
    counted = links.groupBy("other").agg(F.count(F.lit(1)).alias("n"))
    # A document in which very many passages stand first is copied to several parts; the others go to one each.
    salts = F.broadcast(hot_keys(counted, "other", "n", links.count()))
    part = F.pmod(F.xxhash64("other", "salt"), F.lit(blocks)).cast("int").alias("part")
    links = links.join(salts, "other", "left").withColumn("salt", F.pmod(F.xxhash64("doc"), F.coalesce("salts", F.lit(1))).cast("int"))
    copies = holders.join(salts, "other", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    names = ["start_word", "end_word", "first_start", "first_end", "n_matching"]
    kinds = [(key, pa.int64()), ("first_doc_id", pa.int64()), *[(name, pa.int64()) for name in names]]

    def run(table: pa.Table, texts: pa.Table) -> pa.Table:
        held = {doc: np.frombuffer(words.as_py(), np.uint32) for doc, words in zip(texts.column("other").to_pylist(), texts.column("words"))}
        passages: dict[tuple, set] = {}
        for chain in table.to_pylist():
            own, other = np.frombuffer(chain["words"], np.uint32), held[chain["other"]]
            passages.setdefault((chain["doc"], chain["other"]), set()).update(aligned(own, chain["first"], other, chain["here"], chain["there"], least, percent))
        rows = [(*pair, *passage) for pair, found in passages.items() for passage in covering(sorted(found))]
        return pa.table({name: pa.array([r[c] for r in rows], kind) for c, (name, kind) in enumerate(kinds)})

    schema = f"`{key}` bigint, first_doc_id bigint, " + ", ".join(f"{name} bigint" for name in names)
    left = links.select(part, "doc", "other", "first", "words", "here", "there").groupBy("part")
    return left.cogroup(copies.select(part, "other", "words").groupBy("part")).applyInArrow(run, schema).dropDuplicates()
