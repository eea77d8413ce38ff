"""Encoding and decoding with merge vocabularies by a table of last tokens.

The tokens of a prefix end in one token that the prefix alone decides. For each position the automaton gives all
tokens that end there; the last token is the one that may follow the last token of what stands before it. Two tokens
may stand side by side if undoing their merges, the later one first, never shows a pair that would have been merged
earlier. The ids are then read off backwards. No merge is ever carried out on the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidemark.llm.batches import add_columns, sha256
from tidemark.llm.pieces import MERGES, SPACE, Vocabulary, matcher, read_model

#: Entries of a memo of parts or pairs before it starts anew; bounds the memory of a worker.
MEMO = 200_000
#: A vocabulary file is sent to every executor; larger files are refused.
MOST_BYTES = 64 << 20


def merge_tables(model: dict) -> dict:
    """The last merge of every token, found by merging its own characters; tokens that fall apart are left out."""
    if model["kind"] != MERGES:
        raise ValueError("not a merge vocabulary")
    normal = {piece: score for piece, score, kind in model["pieces"] if kind == 1}
    order = {score: k for k, score in enumerate(sorted(set(normal.values()), reverse=True))}
    made: dict[str, tuple[str, str]] = {}
    for piece in normal:
        symbols, last = list(piece), None
        while len(symbols) > 1:
            best = None
            for k in range(len(symbols) - 1):
                score = normal.get(symbols[k] + symbols[k + 1])
                if score is not None and (best is None or score > best[0]):
                    best = (score, k)
            if best is None:
                break
            k = best[1]
            last = (symbols[k], symbols[k + 1])
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
        if len(symbols) == 1 and last:
            made[piece] = last
    rank = {piece: order[normal[piece]] for piece in made}
    if any(rank.get(part, -1) > rank[piece] for piece, parts in made.items() for part in parts):
        raise ValueError("a token ranks before one of its parts")
    return model | {"made": made, "rank": rank, "ranks": {piece: order[score] for piece, score in normal.items()}}


class MergeEncoder(Vocabulary):
    def __init__(self, tables: dict):
        super().__init__(tables)
        self.made, self.rank, self.ranks = tables["made"], tables["rank"], tables["ranks"]
        tokens = {*self.made, *{c for piece in self.normal for c in piece}}
        #: For each token the tokens that were asked about before it, and whether they may stand there.
        self.ahead: dict[str, dict[str, bool]] = {token: {} for token in tokens}
        self.asked = 0
        self.automaton = matcher({token: (token, len(token), self.ahead[token]) for token in tokens})
        self.id_texts = {piece: str(k) for piece, k in self.normal.items()}
        self.piece_texts = {str(k): piece.replace(SPACE, " ") for piece, k in self.normal.items()}
        self.ids_by_part: dict[str, str] = {}
        self.text_by_ids: dict[str, str] = {}

    def fits(self, left: str, right: str) -> bool:
        """Whether two tokens may stand side by side."""
        made, rank, ranks = self.made, self.rank, self.ranks
        bound = len(self.pieces)
        while True:
            if ranks.get(left + right, bound) < bound:
                return False
            left_rank, right_rank = rank.get(left, -1), rank.get(right, -1)
            if left_rank > right_rank:
                bound, left = left_rank, made[left][1]
            elif right_rank < 0:
                return True
            else:  # of two merges of one rank the left one comes first
                bound, right = right_rank + 1, made[right][0]

    def tokens(self, part: str) -> list[str]:
        """Tokens of a part: the table forwards, then the ids backwards. A character beyond the vocabulary stands alone."""
        last: list[str | None] = [None] * (len(part) + 1)
        if self.asked > 3 * MEMO:
            for known in self.ahead.values():
                known.clear()
            self.asked = 0
        for end, (token, size, known) in self.automaton.iter(part):
            end += 1
            if last[end] is not None:
                continue
            start = end - size
            if start:
                before = last[start]
                if before is None:
                    before = last[start] = part[start - 1]
                fits = known.get(before)
                if fits is None:
                    fits = known[before] = self.fits(before, token)
                    self.asked += 1
                if not fits:
                    continue
            last[end] = token
        found, at = [], len(part)
        while at:
            token = last[at] or part[at - 1]
            found.append(token)
            at -= len(token)
        found.reverse()
        return found

    def part_ids(self, part: str) -> list[int]:
        ids: list[int] = []
        for token in self.tokens(part):
            known = self.normal.get(token)
            if known is None:
                ids += self.ids_of_unknown(token)
            else:
                ids.append(known)
        return ids

    def encode(self, text: str | None) -> list[int]:
        return [k for part in self.parts(text) for k in self.part_ids(part)]

    def written_ids(self, text: str | None) -> list[str]:
        """Ids of each part, joined by commas; repeated parts come from the memo."""
        memo, id_texts, found = self.ids_by_part, self.id_texts, []
        for part in self.parts(text):
            ids = memo.get(part)
            if ids is None:
                try:
                    ids = ",".join([id_texts[token] for token in self.tokens(part)])
                except KeyError:  # a character without a piece
                    ids = ",".join(map(str, self.part_ids(part)))
                if len(part) <= 64:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[part] = ids
            found.append(ids)
        return found

    def decoded(self, written: list[str]) -> str:
        """Text of the ids of whole parts, as ``decode`` gives it for all ids at once."""
        memo, piece_texts, found = self.text_by_ids, self.piece_texts, []
        for ids in written:
            text = memo.get(ids)
            if text is None:
                try:
                    text = "".join([piece_texts[k] for k in ids.split(",")])
                except KeyError:  # bytes
                    text = self.surface([int(k) for k in ids.split(",")])
                if len(text) <= 64:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[ids] = text
            found.append(text)
        joined = "".join(found)
        return joined[1:] if written and self.pieces[int(written[0].split(",", 1)[0])][0].startswith(SPACE) else joined


def load_merges(path: str) -> dict:
    """Tables of the model file at ``path``, which the driver reads."""
    with open(path, "rb") as file:
        data = file.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ValueError(f"{path} has more than {MOST_BYTES} bytes")
    return merge_tables(read_model(data))


def encoder_of(held: dict) -> MergeEncoder:
    """The encoder of a broadcast value, made once in each worker."""
    if "encoder" not in held:
        held["encoder"] = MergeEncoder(held["tables"])
    return held["encoder"]


def encode_pieces(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds ``ids``, the token ids of each text without begin and end ids.

    A null or empty text has no ids. Rows are encoded each on their own, whatever their length; other columns pass
    through, one called ``ids`` is replaced, and a table without rows stays empty.
    """
    sent = df.sparkSession.sparkContext.broadcast({"tables": load_merges(path)})

    def compute(column: pa.Array) -> list[pa.Array]:
        return [_lists([",".join(encoder_of(sent.value).written_ids(value.as_py())) for value in column])]

    return add_columns(df, text, "ids array<int>", compute)


def _lists(written: list[str]) -> pa.Array:
    """Lists of ids from their written form."""
    rows = [np.fromstring(ids, np.int32, sep=",") for ids in written]
    offsets = np.concatenate(([0], np.cumsum([len(row) for row in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *rows])))


def encode_checked(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds ``ids``, ``n_tokens`` and ``decoded_sha256``, the hash of the text decoded from the ids; drops the text.

    Nulls, repeated rows and clashing columns are handled as by ``encode_pieces``.
    """
    sent = df.sparkSession.sparkContext.broadcast({"tables": load_merges(path)})

    def compute(column: pa.Array) -> list[pa.Array]:
        encoder = encoder_of(sent.value)
        ids, back = [], []
        for value in column:
            written = encoder.written_ids(value.as_py())
            ids.append(",".join(written))
            back.append(sha256(encoder.decoded(written)))
        lists = _lists(ids)
        return [lists, pc.list_value_length(lists).cast(pa.int64()), pa.array(back, pa.string())]

    return add_columns(df, text, "ids array<int>, n_tokens bigint, decoded_sha256 string", compute, keep_text=False)


def decode_pieces(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded``, the text of each list of ids; null counts as no ids, null members are left out."""
    sent = df.sparkSession.sparkContext.broadcast({"tables": load_merges(path)})

    def compute(column: pa.Array) -> list[pa.Array]:
        encoder = encoder_of(sent.value)
        return [pa.array([encoder.decode([k for k in row or () if k is not None]) for row in column.to_pylist()], pa.string())]

    return add_columns(df, ids, "decoded string", compute)


def encoding_digest(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Number and hash of the ids and hash of the text decoded from them, for each row; drops the text."""
    sent = df.sparkSession.sparkContext.broadcast({"tables": load_merges(path)})

    def compute(column: pa.Array) -> list[pa.Array]:
        encoder = encoder_of(sent.value)
        counts, hashes, back = [], [], []
        for value in column:
            written = encoder.written_ids(value.as_py())
            ids = ",".join(written)
            counts.append(ids.count(",") + 1 if ids else 0)
            hashes.append(sha256(ids))
            back.append(sha256(encoder.decoded(written)))
        return [pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(back, pa.string())]

    return add_columns(df, text, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", compute, keep_text=False)
