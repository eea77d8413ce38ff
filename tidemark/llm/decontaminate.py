"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton holds every run of words of every item. A document streams through it word by word; the state tells the
longest run of item words that ends at the word. Where that length reaches the window, or a whole shorter item ends, the
words are hit.

Items are cut into blocks of at most ``block_words`` words, one automaton each, so what is sent to the executors for one
block has a proven bound; a larger benchmark takes more blocks, each a further pass over the documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.batches import buffer_of, column, set_aside
from tidemark.llm.words import LETTERED, slices, word_bounds, word_hashes

#: Words of one item in a window.
WINDOW = 13
#: A document is contaminated when hit words are at least one in so many.
ONE_IN = 20
#: Words of items in one automaton.
BLOCK_WORDS = 200_000

_HIT = ("first", "end", "start_byte", "end_byte")
_HITS = f"hits array<struct<{','.join(name + ':bigint' for name in _HIT)}>>"
_WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
_LOWER = {code: code + 32 for code in range(65, 91)}


def words_of(text: str | None) -> list[str]:
    """Words of a text: A to Z lower-cased, runs of ASCII letters, digits and anything beyond ASCII."""
    return _WORD.findall(text.translate(_LOWER)) if text else []


class Automaton:
    """Generalised suffix automaton over the words of items, with the items that hold each window."""

    def __init__(self, items: list[tuple[str, list[str]]], window: int):
        self.window = window
        self.names = [name for name, _ in items]
        self.vocabulary: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends = []
        for _, words in items:
            last, path = 0, []
            for word in words:
                last = self._extend(last, self.vocabulary.setdefault(word, len(self.vocabulary)))
                path.append(last)
            ends.append(path)
        holders: list[set[int]] = [set() for _ in self.link]
        self.whole: list[list[int]] = [[] for _ in self.link]
        for item, path in enumerate(ends):
            for state in path:
                while state > 0 and item not in holders[state]:
                    holders[state].add(item)
                    state = self.link[state]
            if path and len(path) < window:
                self.whole[path[-1]].append(item)
        #: State of the last ``window`` words -> items that hold them.
        self.holders = [tuple(h) for h in holders]
        self.least = min([window, *(len(words) for _, words in items if words)])
        self.short = [len(words) for _, words in items]

    def _extend(self, last: int, word: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        known = nxt[last].get(word)
        if known is not None and length[known] == length[last] + 1:
            return known
        if known is None:
            state = self._state(length[last] + 1, {})
            at = last
            while at >= 0 and word not in nxt[at]:
                nxt[at][word] = state
                at = link[at]
            if at < 0:
                link[state] = 0
                return state
            target = nxt[at][word]
            link[state] = target if length[at] + 1 == length[target] else self._split(at, word, target)
            return state
        return self._split(last, word, known)

    def _state(self, length: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(-1)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, at: int, word: int, target: int) -> int:
        copy = self._state(self.length[at] + 1, dict(self.next[target]))
        self.link[copy], self.link[target] = self.link[target], copy
        while at >= 0 and self.next[at].get(word) == target:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def hits(self, words: Iterable[int]) -> Iterator[tuple[int, int, int]]:
        """(position, length, item) of every item part that ends at a position of a run of known words."""
        state, matched = 0, 0
        nxt, link, length, window = self.next, self.link, self.length, self.window
        for position, word in enumerate(words):
            while state and word not in nxt[state]:
                state = link[state]
                matched = length[state]
            state = nxt[state].get(word, 0)
            matched = matched + 1 if state else 0
            at = state
            while at > 0:
                if matched >= window and length[link[at]] < window <= min(matched, length[at]):
                    for item in self.holders[at]:
                        yield position, window, item
                if self.whole[at] and (at != state or matched >= length[at]):
                    for item in self.whole[at]:
                        if self.short[item] == length[at]:
                            yield position, length[at], item
                at = link[at]


def _blocks(items: Iterable[tuple[str, list[str]]], size: int) -> Iterator[list[tuple[str, list[str]]]]:
    block, held = [], 0
    for item in items:
        if block and held + len(item[1]) > size:
            yield block
            block, held = [], 0
        block.append(item)
        held += len(item[1])
    if block:
        yield block


def _scan(vocabulary: tuple[np.ndarray, np.ndarray], automaton: Automaton, batch_column: pa.Array):
    """Per document: number of words, hit stretches as (first word, end word, start byte, end byte), items hit."""
    keys, ids = vocabulary
    offsets, data = buffer_of(batch_column)
    for first, last in slices(offsets):
        part = offsets[first : last + 1]
        starts, ends, firsts = word_bounds(data, part, LETTERED)
        hashes = word_hashes(data, int(part[0]), starts, ends)
        where = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1) if len(keys) else np.zeros(len(hashes), int)
        known = keys[where] == hashes if len(keys) else np.zeros(len(hashes), bool)
        # Only stretches of known words that are as long as the shortest window can hold a hit.
        borders = np.zeros(len(hashes) + 1, bool)
        borders[firsts[firsts <= len(hashes)]] = True
        edge = np.zeros(len(hashes) + 2, bool)
        edge[1:-1] = known
        begins = np.flatnonzero(known & (~edge[:-2] | borders[:-1]))
        stops = np.flatnonzero(known & (~edge[2:] | borders[1:])) + 1
        long = stops - begins >= automaton.least
        found: dict[int, list[tuple[int, int, int]]] = {}
        for begin, stop in zip(begins[long].tolist(), stops[long].tolist()):
            got = [(begin + p - size + 1, begin + p + 1, item) for p, size, item in automaton.hits(ids[where[begin:stop]].tolist())]
            if got:
                found.setdefault(int(np.searchsorted(firsts, begin, side="right")) - 1, []).extend(got)
        counts = np.diff(firsts)
        base = int(part[0])
        for doc in range(last - first):
            own = found.get(doc, ())
            inside, start = int(part[doc]) - base, int(firsts[doc])
            stretches = _united(
                [(a - start, b - start, int(starts[a]) - inside, int(ends[b - 1]) - inside) for a, b in {(a, b) for a, b, _ in own}]
            )
            yield int(counts[doc]), stretches, sorted({item for _, _, item in own})


def _items(benchmark: DataFrame, item_id: str, text: str) -> Iterator[tuple[str, list[str]]]:
    """Items with words, streamed partition by partition in a fixed order; a null id counts as empty text."""
    rows = benchmark.select(F.coalesce(column(item_id).cast("string"), F.lit("")).alias("i"), column(text).alias("t"))
    for row in rows.orderBy("i", "t").toLocalIterator():
        words = words_of(row["t"])
        if words:
            yield row["i"], words


def benchmark_hits(
    df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Adds ``n_words``, ``hits`` (first and end word, start and end byte of each hit stretch) and ``items`` (ids found).

    A null or empty text has no words and no hits; items without words are left out, a null item id counts as the
    empty string, items with equal ids or texts all count. Whole texts are read whatever their length. Repeated rows are judged each on their own. Input
    columns with the names of new ones are replaced.
    """
    result = None
    blocks = _blocks(_items(benchmark, item_id, item_text), block_words)
    for block in blocks:
        result = _with_block(df if result is None else result, block, text, window, merge=result is not None)
    return result if result is not None else _with_block(df, [], text, window, merge=False)


def _united(*lists: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Stretches of several lists, those that meet or overlap made one."""
    joined: list[tuple[int, int, int, int]] = []
    for stretch in sorted(s for one in lists for s in one):
        if joined and stretch[0] <= joined[-1][1]:
            first, end, start_byte, end_byte = joined[-1]
            joined[-1] = (first, max(end, stretch[1]), start_byte, max(end_byte, stretch[3]))
        else:
            joined.append(stretch)
    return joined


def _with_block(df: DataFrame, block: list[tuple[str, list[str]]], text: str, window: int, merge: bool) -> DataFrame:
    spark = df.sparkSession
    own = ["n_words", "hits", "items"]
    kept = [c for c in df.columns if c.lower() not in own]
    rows = df.select(*[column(c) for c in kept], *([column("hits"), column("items")] if merge else []))
    added = T._parse_datatype_string(f"n_words bigint, {_HITS}, items array<string>")
    schema = T.StructType([*[rows.schema[i] for i in range(len(kept))], *added.fields])
    names, at, width = schema.names, kept.index(text), len(kept)
    sent = spark.sparkContext.broadcast((block, window))
    kind = pa.list_(pa.struct([(name, pa.int64()) for name in _HIT]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, size = sent.value
        automaton = Automaton(items, size)
        joined = " ".join(automaton.vocabulary).encode("utf-8", "surrogatepass")
        data = np.frombuffer(joined, np.uint8)
        starts, ends, _ = word_bounds(data, np.array([0, len(data)]), LETTERED)
        hashes = word_hashes(data, 0, starts, ends)
        order = np.argsort(hashes)
        vocabulary = (hashes[order], order)
        for batch in batches:
            n, hits, found = [], [], []
            before = zip(batch.column(width).to_pylist(), batch.column(width + 1).to_pylist()) if merge else None
            for words, stretches, ids in _scan(vocabulary, automaton, batch.column(at)):
                mine = {automaton.names[i] for i in ids}
                if before is not None:
                    old, old_items = next(before)
                    stretches = _united([tuple(s[name] for name in _HIT) for s in old], stretches)
                    mine |= set(old_items)
                n.append(words)
                hits.append([dict(zip(_HIT, stretch)) for stretch in stretches])
                found.append(sorted(mine))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:width], pa.array(n, pa.int64()), pa.array(hits, kind), pa.array(found, pa.list_(pa.string()))], names=names
            )

    return rows.mapInArrow(run, schema)


def contamination(hits: DataFrame, one_in: int = ONE_IN) -> DataFrame:
    """Adds ``n_hit``, ``n_items`` and ``contaminated`` to the result of ``benchmark_hits``."""
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda total, hit: total + hit["end"] - hit["first"])
    return hits.withColumns({"n_hit": n_hit, "n_items": F.size("items").cast("bigint")}).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words"))
    )


def contamination_digest(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts, the hash of the ids of the items found, and the verdict."""
    judged = contamination(benchmark_hits(df.select(column(key), column(text)), benchmark, text))
    ids = F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256)
    return judged.select(key, "n_words", "n_hit", "n_items", ids.alias("items_sha256"), "contaminated")


def remove_contaminated(
    df: DataFrame, benchmark: DataFrame, text: str = "text", longest: int | None = None, one_in: int = ONE_IN
) -> DataFrame:
    """``df`` without the contaminated documents; with ``longest``, hit stretches of more words are cut from the others.

    Rows that hold nothing of the benchmark stay as they are, nulls and empty texts among them, and so do columns with
    the names of those that judging adds.
    """
    columns = df.columns
    df, back = set_aside(df, [c for c in ("n_words", "hits", "items", "n_hit", "n_items", "contaminated") if c != text])
    judged = contamination(benchmark_hits(df, benchmark, text), one_in).where(~F.col("contaminated"))
    if longest is not None:
        raw = column(text).cast("binary")
        cuts = F.filter("hits", lambda hit: hit["end"] - hit["first"] > longest)
        edges = F.concat(F.array(F.lit(0).cast("bigint")), F.flatten(F.transform(cuts, lambda hit: F.array(hit["start_byte"], hit["end_byte"]))), F.array(F.octet_length(column(text)).cast("bigint")))
        kept = F.transform(
            F.sequence(F.lit(0), F.size(cuts)),
            lambda k: F.substring(raw, F.element_at(edges, 2 * k + 1).cast("int") + 1, (F.element_at(edges, 2 * k + 2) - F.element_at(edges, 2 * k + 1)).cast("int")),
        )
        whole = F.decode(F.aggregate(kept, F.lit(b""), lambda joined, piece: F.concat(joined, piece)), "UTF-8")
        judged = judged.withColumn(text, F.when(F.size(cuts) > 0, whole).otherwise(column(text)))
    return judged.select(*[column(c) for c in df.columns]).withColumnsRenamed(back).select(*[column(c) for c in columns])
