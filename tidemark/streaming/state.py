"""Counter differencing with the last values kept in Spark's state store.

A poll touches the state of its own keys only, however many others there are; a run that was cut off goes on from the
checkpoint. The processor travels to the executors by value, so they need no copy of the library.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from tidemark.specs import CounterSpec

# The store that can hold more state than memory, and its log of changes in place of whole copies.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def _processor(keys: list[str], counters: list[str], poll: str, baseline: int | None, forget_ms: int | None) -> StatefulProcessor:
    names = [poll, *counters]
    columns = ["kind", *keys, *names]

    class Differences(StatefulProcessor):
        def init(self, handle) -> None:
            kinds = ", ".join(f"`{name}` bigint" for name in names)
            self.last = handle.getValueState("last", kinds, forget_ms)

        def handleInputRows(self, key, rows, timers):
            old = list(self.last.get()) if self.last.exists() else None
            known, moved = old, False
            arrived = sorted((tuple(r[name] for name in names) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0))
            for row in arrived:
                number, values = row[0], row[1:]
                if number is None or (baseline is not None and number < baseline) or (known is not None and number < known[0]):
                    yield Row(*columns)("late", *key, *row)
                elif known is not None and number == known[0]:
                    yield Row(*columns)("repeat", *key, *row)
                else:
                    if number != baseline and (known is not None or baseline is not None):
                        before = known[1:] if known is not None else [0] * len(values)
                        yield Row(*columns)("growth", *key, number, *[None if v is None else v - (b or 0) for v, b in zip(values, before)])
                    held = known[1:] if known is not None else [None] * len(values)
                    known, moved = [number, *[b if v is None else v for v, b in zip(values, held)]], True
            if moved:
                self.last.update(tuple(known))

        def close(self) -> None:
            pass

    return Differences()


def state_deltas(
    polls: DataFrame, spec: CounterSpec, poll: str = "snap_id", baseline: int | None = None, forget_seconds: int | None = None,
    event_time: str | None = None, late_after: str | None = None,
) -> DataFrame:
    """A stream of (kind, keys, poll, counters) rows from a stream of polls.

    ``growth`` rows have the difference to the key's poll before. Polls that one batch brings are taken in their order. A poll that
    is not after the last one of its key is ``late``, or a ``repeat`` if it has the same number; both are given as they came
    and change nothing. A null reading shows a null growth and the next one grows from the last reading there was. With
    ``baseline``, the number of the first poll, that poll shows nothing, a key that comes later grows by its whole
    value, and earlier polls are late; without it, each key's first poll is its own baseline.

    With ``event_time``, polls that have been seen within ``late_after`` are dropped as repeats before they reach a key, and
    those whose time is further back than that, behind the newest one, are dropped by the watermark, which counts them in the query's
    progress. ``forget_seconds`` lets go of keys that no poll has brought for so long; a key that comes back begins anew.
    """
    whole = (poll, *spec.counters)
    kinds = {f.name: f.dataType for f in polls.schema.fields}
    if (event_time is None) != (late_after is None):
        raise ValueError("event_time and late_after go together")
    if event_time is not None:
        timed = polls.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, late_after)
        polls = timed.dropDuplicatesWithinWatermark([*spec.keys, poll])
    rows = polls.select(*spec.keys, *[F.col(c).cast("bigint").alias(c) for c in whole])
    schema = T.StructType([T.StructField("kind", T.StringType()), *[T.StructField(k, kinds[k]) for k in spec.keys], *[T.StructField(c, T.LongType()) for c in whole]])
    processor = _processor(list(spec.keys), list(spec.counters), poll, baseline, None if forget_seconds is None else forget_seconds * 1000)
    return rows.groupBy(*spec.keys).transformWithState(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="None" if forget_seconds is None else "ProcessingTime"
    )


def start_state_deltas(deltas: DataFrame, folder: str, checkpoint: str, poll_seconds: int | None = None) -> StreamingQuery:
    """Writes the rows of :func:`state_deltas` below ``folder``, one folder per kind; without ``poll_seconds`` to the end of the input."""
    spark = deltas.sparkSession
    before = {name: spark.conf.get(name, None) for name in STORE}
    # A query takes the settings of its session as it starts, and keeps them.
    for name, value in STORE.items():
        spark.conf.set(name, value)
    try:
        writer = deltas.writeStream.format("parquet").partitionBy("kind").option("path", folder).option("checkpointLocation", checkpoint)
        trigger = {"availableNow": True} if poll_seconds is None else {"processingTime": f"{poll_seconds} seconds"}
        return writer.trigger(**trigger).start()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def read_kind(spark: SparkSession, folder: str, schema: T.StructType, kind: str) -> DataFrame:
    """The rows of one kind that a query has written: growth, late or repeat."""
    return spark.read.schema(schema).option("basePath", folder).parquet(folder).filter(F.col("kind") == kind).drop("kind")
