"""Quality classification by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes. A passage is encoded from the frequencies of its pairs of byte
kinds; a gate and an attention weight, both learned, say how much it counts; the label is judged from the weighted sum
of the encoded passages. Only document labels are needed to learn all of it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import add_columns, buffer_of, column
from tidemark.llm.language import held_out
from tidemark.llm.words import slices

#: Bytes of a passage.
PASSAGE = 512
#: Labelled documents that are learned from, the first by a hash of their id.
LEARNED_DOCUMENTS = 6_000
#: Passages of one document that are learned from, evenly spaced; scoring uses all of them.
LEARNED_PASSAGES = 64
ENCODED, HIDDEN, ROUNDS, BATCH = 24, 16, 40, 64
KINDS = 20


def byte_kinds() -> np.ndarray:
    """A kind for every byte: letters by case, digits, white space, marks one by one or in families, the rest."""
    kinds = np.full(256, KINDS - 1, np.uint16)
    kinds[128:] = 1
    kinds[97:123] = 2
    kinds[65:91] = 3
    kinds[48:58] = 4
    for kind, members in enumerate((b" ", b"\n", b"\t\r\x0b\x0c", b".", b",", b"!", b"?", b"|", b"%&$#*@", b"\"'`", b"()[]{}", b":;", b"-_/\\", b"<>=+~^"), start=5):
        kinds[list(members)] = kind
    return kinds


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages and the first passage of each document (n + 1); an empty text is one blank passage."""
    base = int(offsets[0])
    sizes = np.diff(offsets)
    counts = np.maximum(1, -(-sizes // PASSAGE))
    firsts = np.concatenate(([0], np.cumsum(counts)))
    kinds = byte_kinds()[data[base : int(offsets[-1])]].astype(np.int64)
    inside = np.arange(len(kinds)) - np.repeat(offsets[:-1] - base, sizes)
    passage = np.repeat(firsts[:-1], sizes) + inside // PASSAGE
    together = passage[1:] == passage[:-1]
    pairs = (passage[:-1] * (KINDS * KINDS) + kinds[:-1] * KINDS + kinds[1:])[together]
    table = np.bincount(pairs, minlength=int(firsts[-1]) * KINDS * KINDS).reshape(-1, KINDS * KINDS).astype(np.float32)
    table /= np.maximum(table.sum(axis=1, keepdims=True), 1)
    return np.sqrt(table), firsts


def forward(model: dict[str, np.ndarray], rows: np.ndarray, firsts: np.ndarray) -> dict[str, np.ndarray]:
    """All steps from passage features to document scores."""
    encoded = np.tanh(rows @ model["encode"] + model["encode_bias"])
    view = np.tanh(encoded @ model["view"])
    gate = 1 / (1 + np.exp(-(encoded @ model["gate"])))
    energy = (view * gate) @ model["weigh"]
    top = np.maximum.reduceat(energy, firsts[:-1])
    sizes = np.diff(firsts)
    weight = np.exp(energy - np.repeat(top, sizes))
    weight /= np.repeat(np.add.reduceat(weight, firsts[:-1]), sizes)
    pooled = np.add.reduceat(encoded * weight[:, None], firsts[:-1], axis=0)
    logit = pooled @ model["judge"] + model["judge_bias"]
    return {"encoded": encoded, "view": view, "gate": gate, "weight": weight, "pooled": pooled, "score": 1 / (1 + np.exp(-np.clip(logit, -40, 40)))}


def gradients(model: dict[str, np.ndarray], rows: np.ndarray, firsts: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean cross entropy."""
    step = forward(model, rows, firsts)
    sizes = np.diff(firsts)
    error = (step["score"] - labels) / len(labels)
    spread = np.repeat(error, sizes)
    pooled = np.repeat(step["pooled"], sizes, axis=0)
    by_encoded = spread[:, None] * step["weight"][:, None] * model["judge"][None, :]
    by_energy = spread * step["weight"] * ((step["encoded"] - pooled) @ model["judge"])
    by_view = by_energy[:, None] * model["weigh"][None, :] * step["gate"] * (1 - step["view"] ** 2)
    by_gate = by_energy[:, None] * model["weigh"][None, :] * step["view"] * step["gate"] * (1 - step["gate"])
    by_encoded = by_encoded + by_view @ model["view"].T + by_gate @ model["gate"].T
    by_input = by_encoded * (1 - step["encoded"] ** 2)
    return {
        "encode": rows.T @ by_input, "encode_bias": by_input.sum(axis=0), "view": step["encoded"].T @ by_view,
        "gate": step["encoded"].T @ by_gate, "weigh": (step["view"] * step["gate"]).T @ by_energy,
        "judge": step["pooled"].T @ error, "judge_bias": error.sum(),
    }


def new_model(seed: int = 7) -> dict[str, np.ndarray]:
    draw = np.random.default_rng(seed)
    shapes = {"encode": (KINDS * KINDS, ENCODED), "view": (ENCODED, HIDDEN), "gate": (ENCODED, HIDDEN), "weigh": (HIDDEN,), "judge": (ENCODED,)}
    model = {name: draw.normal(0, 1 / np.sqrt(shape[0]), shape) for name, shape in shapes.items()}
    model["encode"] *= 4
    return model | {"encode_bias": np.zeros(ENCODED), "judge_bias": np.zeros(())}


def fit(bags: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """A model fitted to bags of passages by Adam in a fixed order of drawing."""
    model = new_model(seed)
    first = {name: np.zeros_like(value) for name, value in model.items()}
    second = {name: np.zeros_like(value) for name, value in model.items()}
    draw, step = np.random.default_rng(seed + 1), 0
    for turn in range(ROUNDS):
        order = draw.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            firsts = np.concatenate(([0], np.cumsum([len(bags[k]) for k in chosen])))
            grads = gradients(model, np.concatenate([bags[k] for k in chosen]).astype(np.float64), firsts, labels[chosen])
            step += 1
            rate = 0.01 * (1 - turn / ROUNDS) + 0.0005
            for name, grad in grads.items():
                grad = grad + 1e-5 * model[name]
                first[name] = 0.9 * first[name] + 0.1 * grad
                second[name] = 0.999 * second[name] + 0.001 * grad**2
                model[name] = model[name] - rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
    return model


def learn_quality(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> dict[str, np.ndarray] | None:
    """A model from at most ``LEARNED_DOCUMENTS`` labelled documents outside the held-out third.

    Null ids, labels and texts are not learned from; several labels of one id count as their mean, and rows of one id
    all count. Null if nothing is left to learn from.
    """
    marked = labels.select(column(key).alias("_k"), column(label).cast("double").alias("_y"))
    marked = marked.where(F.col("_k").isNotNull() & F.col("_y").isNotNull() & ~held_out(F.col("_k"), 3, 1))
    marked = marked.groupBy("_k").agg(F.avg("_y").alias("_y"))
    # The hash order makes a bounded draw that no other column can steer; at most LEARNED_DOCUMENTS short rows are sent.
    chosen = F.broadcast(marked.orderBy(F.xxhash64(F.col("_k").cast("string")), "_k").limit(LEARNED_DOCUMENTS))
    rows = df.select(column(key).alias("_k"), column(text).alias("_t")).where(F.col("_t").isNotNull())
    joined = rows.join(chosen, "_k").select("_t", "_y", F.xxhash64(F.col("_k").cast("string")).alias("_h"))

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = buffer_of(batch.column(0))
            bags = []
            for a, b in slices(offsets, 1 << 18):
                table, firsts = passages(data, offsets[a : b + 1])
                for x, y in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
                    picked = np.unique(np.linspace(x, y - 1, min(y - x, LEARNED_PASSAGES)).astype(int))
                    bags.append(table[picked].astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(bags, pa.binary()), batch.column(1), batch.column(2)], names=["bag", "y", "h"])

    drawn = joined.mapInArrow(encode, "bag binary, y double, h bigint").orderBy("h", "bag").limit(LEARNED_DOCUMENTS).collect()
    if not drawn:
        return None
    bags = [np.frombuffer(row["bag"], np.float16).reshape(-1, KINDS * KINDS) for row in drawn]
    return fit(bags, np.array([row["y"] for row in drawn]))


def score_quality(df: DataFrame, model: dict[str, np.ndarray] | None, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds ``score``, the probability that the label is 1, and ``predicted`` (1 from 0.5).

    All passages of every whole text count; a null or empty text is one blank passage and has a score like any other.
    Without a model every score is 0.5. Repeated rows get equal scores; other columns pass through, those with the names
    of new ones are replaced.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    def compute(batch_column: pa.Array) -> list[pa.Array]:
        offsets, data = buffer_of(batch_column)
        scores = []
        for a, b in slices(offsets, 1 << 18):
            if sent.value is None:
                scores.append(np.full(b - a, 0.5))
            else:
                table, firsts = passages(data, offsets[a : b + 1])
                scores.append(forward(sent.value, table, firsts)["score"])
        score = np.concatenate(scores) if scores else np.empty(0)
        return [pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))]

    return add_columns(df, text, "score double, predicted int", compute, keep_text)


def quality_digest(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with its score; the third left out of learning is marked held out."""
    model = learn_quality(df, labels, key, text)
    return score_quality(df.select(column(key), held_out(column(key), 3, 1).alias("held_out"), column(text)), model, text, keep_text=False)
