"""Token counts under a unigram vocabulary without making the tokens.

The automaton gives every piece that ends at a position. For each position only the best score and the number of pieces
on that path are kept. Scores add up in single precision from the start of the text, as the tokenizer does, and
a later candidate wins only with a higher score; candidates come by their start, the leftmost first.

A candidate is compared before it is rounded, as the tokenizer does.

No piece reaches over the border of a part, so a part is worked out on its own for the score it starts from. How
sums round depends on the binade of that score and the parity of its last bit alone, so results are kept by
(part, binade, parity) and used again as long as no sum leaves the binade. This holds for whole-number scores, for
which all sums are whole numbers; other vocabularies are worked out position by position.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.batches import add_columns
from tidemark.llm.merge_encoding import MEMO, MOST_BYTES
from tidemark.llm.pieces import Vocabulary, matcher, read_model

#: Fixed value of the tokenizer: an unknown character scores so much below the worst piece.
UNKNOWN_PENALTY = 10.0
_EXACT = 24


class PieceCounter(Vocabulary):
    def __init__(self, model: dict):
        super().__init__(model)
        scores = [self.pieces[k][1] for k in self.normal.values()]
        self.whole = all(score == int(score) for score in scores)
        number = int if self.whole else float
        self.rounded = _single if self.whole else lambda value: float(np.float32(value))
        self.unknown_score = self.rounded(number(min(scores, default=0.0) - UNKNOWN_PENALTY))
        self.automaton = matcher({piece: (len(piece), number(self.pieces[k][1])) for piece, k in self.normal.items()})
        self.memo: dict[tuple[str, int, int], tuple[int, int, int]] = {}

    def part_counts(self, part: str, score):
        """Number of pieces of ``part``, the score after it, the largest size of a sum on the way."""
        n = len(part)
        best: list = [None] * (n + 1)
        count = [0] * (n + 1)
        best[0], largest, done = score, abs(score), 0
        rounded = self.rounded

        def alone(end: int) -> None:  # no piece of one character: it is unknown
            nonlocal largest
            total = rounded(best[end - 1] + self.unknown_score)
            if abs(total) > largest:
                largest = abs(total)
            if best[end] is None or total > best[end]:
                best[end] = total
                count[end] = count[end - 1] + len(self.ids_of_unknown(part[end - 1]))

        short = False
        for end, (size, piece_score) in self.automaton.iter(part):
            end += 1
            if end > done:
                if done and not short:
                    alone(done)
                for missed in range(done + 1, end):
                    alone(missed)
                done, short = end, False
            if size == 1:
                short = True
            total = best[end - size] + piece_score
            if abs(total) > largest:
                largest = abs(total)
            if best[end] is None or total > best[end]:
                best[end] = rounded(total)
                count[end] = count[end - size] + 1
        if done and not short:
            alone(done)
        for missed in range(done + 1, n + 1):
            alone(missed)
        return count[n], best[n], largest

    def count(self, text: str | None) -> int:
        """Number of pieces of a text."""
        score = 0 if self.whole else 0.0
        pieces, memo = 0, self.memo
        for part in self.parts(text):
            if not self.whole:
                found, score, _ = self.part_counts(part, score)
                pieces += found
                continue
            size = abs(score)
            binade = size.bit_length() - _EXACT
            if binade <= 0:
                binade, parity = 0, 0
            else:
                parity = (size >> binade) & 1
            key = (part, binade, parity)
            kept = memo.get(key)
            if kept is not None and size + kept[2] < (1 << (binade + _EXACT)):
                pieces += kept[0]
                score += kept[1]
                continue
            found, after, largest = self.part_counts(part, score)
            if kept is None and len(part) <= 64 and largest < (1 << (binade + _EXACT)):
                if len(memo) >= 2 * MEMO:
                    memo.clear()
                memo[key] = (found, after - score, largest - size)
            pieces += found
            score = after
        return pieces


def _single(value: int) -> int:
    """A whole number rounded to single precision, halves to even."""
    size = abs(value)
    extra = size.bit_length() - _EXACT
    if extra <= 0:
        return value
    unit = 1 << extra
    kept, rest = size >> extra, size & (unit - 1)
    if rest * 2 > unit or (rest * 2 == unit and kept & 1):
        kept += 1
    return kept << extra if value >= 0 else -(kept << extra)


def by_rank(model: dict) -> dict:
    """The model with each piece scored by its place in the file: Zipf's logarithm, in whole sixteenths."""
    zipf = [-float(round(16 * math.log(k + 2))) for k in range(len(model["pieces"]))]
    return model | {"pieces": [(piece, zipf[k], kind) for k, (piece, _, kind) in enumerate(model["pieces"])]}


def token_counts(df: DataFrame, path: str, text: str = "text", keep_text: bool = True, ranked: bool = False) -> DataFrame:
    """Adds ``n_tokens``, the number of pieces of the best path of each text.

    The pieces of the file are read as a unigram vocabulary, with the scores of the file or, with ``ranked``, scored by
    their place in it, which is how a merge vocabulary without probabilities is read. A null or empty
    text has none. Rows are counted each on their own, whatever their length; other columns pass through, one called
    ``n_tokens`` is replaced, and a table without rows stays empty.
    """
    with open(path, "rb") as file:
        data = file.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ValueError(f"{path} has more than {MOST_BYTES} bytes")
    sent = df.sparkSession.sparkContext.broadcast({"model": by_rank(read_model(data)) if ranked else read_model(data)})

    def compute(column: pa.Array) -> list[pa.Array]:
        held = sent.value
        if "counter" not in held:
            held["counter"] = PieceCounter(held["model"])
        return [pa.array([held["counter"].count(value.as_py()) for value in column], pa.int64())]

    return add_columns(df, text, "n_tokens bigint", compute, keep_text)
