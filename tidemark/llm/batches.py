"""Arrow helpers shared by the operators: added columns, text buffers, hashes, hot-key joins."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.words import slices


def column(name: str):
    """The column of exactly this name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def texts_of(array: pa.Array) -> list[str]:
    """Strings of an Arrow column; null counts as empty."""
    return pc.fill_null(array, "").to_pylist()


def buffer_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string or binary column without copying; null counts as empty."""
    array = pc.fill_null(array, b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    array = array.cast(pa.large_binary())
    _, offsets, data = array.buffers()
    positions = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    return positions, np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)


def binary_column(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    """A binary column over consecutive stretches of ``data``; the inverse of ``buffer_of``."""
    return pa.Array.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    ).cast(pa.binary())


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def add_columns(
    df: DataFrame, text: str, fields: str, compute: Callable[[pa.Array], Sequence[pa.Array]], keep_text: bool = True
) -> DataFrame:
    """``df`` with columns computed from its column ``text`` by Arrow batches.

    An input column with the name of a new one (in either case) is replaced; all others pass through, ``text`` only
    with ``keep_text``.
    """
    added = T._parse_datatype_string(fields)
    taken = {name.lower() for name in added.names} | (set() if keep_text else {text.lower()})
    passed = [c for c in df.columns if c.lower() not in taken]
    at = passed.index(text) if text in passed else len(passed)
    extra = [] if text in passed else [column(text).alias("_source_text")]
    rows = df.select(*[column(c) for c in passed], *extra)
    schema = T.StructType([*[rows.schema[i] for i in range(len(passed))], *added.fields])
    names, kept = schema.names, len(passed)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_slices(batch, at):
                yield pa.RecordBatch.from_arrays([*part.columns[:kept], *compute(part.column(at))], names=names)

    return rows.mapInArrow(run, schema)


#: Bytes of text that are worked on at once; what is made of them is passed on before the next ones.
SLICE_BYTES = 4 << 20


def in_slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Stretches of rows of ``batch`` with about ``SLICE_BYTES`` in column ``at``, at least one row each."""
    kind = batch.column(at).type
    if not batch.num_rows or not (pa.types.is_string(kind) or pa.types.is_large_string(kind)):
        yield batch
        return
    offsets, _ = buffer_of(batch.column(at))
    for first, last in slices(offsets, SLICE_BYTES):
        yield batch.slice(first, last - first)


def set_aside(df: DataFrame, names: Iterable[str]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns of these names (in either case) renamed, and the way back for ``withColumnsRenamed``."""
    taken = {name.lower() for name in names}
    renamed = {c: f"_aside_{k}" for k, c in enumerate(df.columns) if c.lower() in taken}
    return df.withColumnsRenamed(renamed), {new: old for old, new in renamed.items()}


def hot_join(facts: DataFrame, lookup: DataFrame, key: str, hot: DataFrame, spread_by: str, how: str = "inner") -> DataFrame:
    """Joins ``facts`` to ``lookup`` on ``key`` with the keys in ``hot`` dealt over several tasks.

    ``hot`` has ``key`` and ``salts``, the number of parts of that key; ``hot_keys`` makes it and proves its size.
    Rows of ``lookup`` are repeated for hot keys only. ``spread_by`` is a column of ``facts`` that tells its rows apart.
    """
    marks = F.broadcast(hot.select(key, "salts"))
    salted = facts.join(marks, key, "left").withColumn(
        "_salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread_by), F.col("salts"))).cast("int")
    ).drop("salts")
    copies = lookup.join(marks, key, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)).cast("int") - 1))
    ).drop("salts")
    return salted.join(copies, [key, "_salt"], how).drop("_salt")


#: At most so many keys can be hot, whatever the input.
MOST_HOT = 10_000


def hot_keys(counted: DataFrame, key: str, count: str, total: int, least: int = 2_000) -> DataFrame:
    """The keys that hold more rows than a task should have, with their number of parts.

    A key is hot above ``max(least, total / MOST_HOT)`` rows, so there are at most ``MOST_HOT`` of them: the
    table may be broadcast.
    """
    share = max(least, -(-total // MOST_HOT))
    return counted.where(F.col(count) > share).select(key, F.ceil(F.col(count) / share).cast("int").alias("salts"))
