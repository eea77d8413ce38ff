"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A run of three letters is the product of its
letters' vectors, each permuted by its place in the run. A document is the sum of its runs, a language the sum of its
documents, each scaled to length one; the language whose vector makes the smallest angle with the document's is chosen.

Vectors are kept as bits: the product is then an exclusive or, the permutation a rotation of 64-bit words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import add_columns, column, texts_of
from tidemark.llm.words import mixed

#: Length of the vectors in 64-bit words.
WORDS = 16
#: About so many documents of each language are learned from, chosen by a hash of their id.
LEARNED_PER_LANGUAGE = 2_000
#: More languages than this are refused, as their vectors go to every task.
MOST_LANGUAGES = 2_000
#: Characters worked on at once.
SLICE = 1 << 18
UNKNOWN = "und"


def letter_table() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000)


def runs_of(text: str, letters: np.ndarray) -> np.ndarray | None:
    """Codes of the runs of three in lower-cased ``text``; other characters are one border. Null if it has no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    known = letters[codes]
    if not known.any():
        return None
    padded = np.zeros(len(codes) + 2, np.uint64)
    padded[1:-1] = np.where(known, codes, 0)
    kept = np.ones(len(padded), bool)
    kept[1:] = (padded[1:] != 0) | (padded[:-1] != 0)
    padded = padded[kept]
    return (padded[:-2] << np.uint64(42)) | (padded[1:-1] << np.uint64(21)) | padded[2:]


def _letter_bits(codes: np.ndarray) -> np.ndarray:
    places = np.arange(WORDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mixed(codes[:, None] * np.uint64(0xD1342543DE82EF95) + places[None, :] + np.uint64(1))


def run_vectors(runs: np.ndarray) -> np.ndarray:
    """One row of +1 and -1 for each run code."""
    low = np.uint64((1 << 21) - 1)
    bits = np.roll(_letter_bits(runs >> np.uint64(42)), 2, axis=1)
    bits ^= np.roll(_letter_bits((runs >> np.uint64(21)) & low), 1, axis=1)
    bits ^= _letter_bits(runs & low)
    signs = np.unpackbits(bits.view(np.uint8), axis=1).astype(np.float32)
    signs *= 2
    signs -= 1
    return signs


def document_vectors(texts: list[str], letters: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(position of the first, vectors of length one) for stretches of documents; all zeros without a letter."""
    first = 0
    while first < len(texts):
        last, held = first, 0
        while last < len(texts) and (last == first or held + len(texts[last]) <= SLICE):
            held += len(texts[last])
            last += 1
        distinct, counts, sizes = [], [], []
        for text in texts[first:last]:
            runs = runs_of(text, letters)
            if runs is None:
                sizes.append(0)
                continue
            runs = np.sort(runs)
            starts = np.flatnonzero(np.concatenate(([True], runs[1:] != runs[:-1])))
            distinct.append(runs[starts])
            counts.append(np.diff(starts, append=len(runs)))
            sizes.append(len(starts))
        vectors = np.zeros((last - first, WORDS * 64), np.float32)
        if distinct:
            runs, where = np.unique(np.concatenate(distinct), return_inverse=True)
            table = np.zeros((last - first, len(runs)), np.float32)
            table[np.repeat(np.arange(last - first), sizes), where] = np.concatenate(counts)
            vectors = table @ run_vectors(runs)
            lengths = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
            vectors /= np.where(lengths > 0, lengths, 1)
        yield first, vectors
        first = last


def held_out(key: Column, parts: int, left_out: int) -> Column:
    """Whether crc32 of the id as text leaves ``left_out`` modulo ``parts``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == left_out


def learn_languages(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Language vectors from about ``LEARNED_PER_LANGUAGE`` rows of each language; nulls are not learned from."""
    rows = df.select(column(key).alias("k"), column(text).alias("t"), column(lang).cast("string").alias("l"))
    rows = rows.where(F.col("t").isNotNull() & F.col("l").isNotNull())
    counted = rows.groupBy("l").count().limit(MOST_LANGUAGES + 1).collect()
    if len(counted) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counted:
        return {}
    space = 1 << 30
    shares = {row["l"]: min(space, space * LEARNED_PER_LANGUAGE // row["count"] + 1) for row in counted}
    share = F.element_at(F.create_map(*[F.lit(x) for pair in shares.items() for x in pair]), F.col("l"))
    chosen = rows.where(F.pmod(F.xxhash64(F.col("k").cast("string"), "l"), F.lit(space)) < share).select("t", "l")

    def bundle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(1).to_pylist()
            for first, vectors in document_vectors(texts_of(batch.column(0)), letters):
                for name, vector in zip(names[first : first + len(vectors)], vectors):
                    sums[name] = sums.get(name, 0) + vector.astype(np.float64)
        for name, vector in sums.items():
            yield pa.RecordBatch.from_pydict({"l": [name] * len(vector), "place": np.arange(len(vector), dtype=np.int32), "value": vector})

    summed = chosen.mapInArrow(bundle, "l string, place int, value double").groupBy("l", "place").agg(F.sum(F.round("value", 6).cast("decimal(30,6)")).cast("double").alias("value"))
    vectors = {name: np.zeros(WORDS * 64) for name in shares}
    for row in summed.collect():
        vectors[row["l"]][row["place"]] = row["value"]
    return {name: vector / max(np.linalg.norm(vector), 1e-12) for name, vector in sorted(vectors.items())}


def identify_languages(df: DataFrame, profiles: dict[str, np.ndarray], text: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds ``lang_pred`` and ``score``, the cosine with that language's vector, 0 at least.

    A null or empty text, or one without a letter, is ``und`` with score 0, as is every text when nothing was learned;
    of equal cosines the first language by name wins. Whole texts count, whatever their length; repeated rows are judged
    each on their own. Other columns pass through, those with the names of new ones are replaced.
    """
    names = sorted(profiles)
    sent = df.sparkSession.sparkContext.broadcast(
        {"names": names, "vectors": np.array([profiles[n] for n in names], np.float32).reshape(len(names), WORDS * 64)}
    )

    def compute(batch_column: pa.Array) -> list[pa.Array]:
        held = sent.value
        if "letters" not in held:
            held["letters"] = letter_table()
        found, scores = [], []
        for _, vectors in document_vectors(texts_of(batch_column), held["letters"]):
            if not held["names"]:
                found += [UNKNOWN] * len(vectors)
                scores += [0.0] * len(vectors)
                continue
            cosines = vectors @ held["vectors"].T
            best = cosines.argmax(axis=1)
            some = vectors.any(axis=1)
            found += [held["names"][k] if s else UNKNOWN for k, s in zip(best.tolist(), some.tolist())]
            scores += np.where(some, np.clip(cosines[np.arange(len(best)), best], 0, 1), 0).astype(float).tolist()
        return [pa.array(found, pa.string()), pa.array(scores, pa.float64())]

    return add_columns(df, text, "lang_pred string, score double", compute, keep_text)


def language_digest(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document; learned from those whose crc32 is no multiple of 5, the others are marked held out."""
    out = held_out(column(key), 5, 0)
    profiles = learn_languages(df.where(~out), key, text, lang)
    rows = df.select(column(key), out.alias("held_out"), column(text))
    return identify_languages(rows, profiles, text, keep_text=False)
