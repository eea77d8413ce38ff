"""Counter differencing over a stream of polls.

Each micro-batch is set against a table of the last value of every key; all of it is DataFrame work. What a batch writes
lies under its own number, so that a batch run again replaces its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.counters import with_ratios
from tidemark.operators.ranking import top_n_per_group
from tidemark.session import remove_folder
from tidemark.specs import CounterSpec

# Rows shown per poll and seconds between polls.
DEFAULT_TOP = 10
DEFAULT_POLL_SECONDS = 1


def _kinds(rows: DataFrame, spec: CounterSpec, poll: str) -> T.StructType:
    """Keys as they are, poll and counters as whole numbers."""
    whole = (poll, *spec.counters)
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    return T.StructType([T.StructField(n, T.LongType() if n in whole else kinds[n]) for n in (*spec.keys, *whole)])


def difference_batch(rows: DataFrame, state: DataFrame | None, spec: CounterSpec, poll: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Growth, new state and late rows of one batch.

    ``state`` has the last poll and values of every key and the first poll of all, ``_first``; none before the first batch. The
    first poll seen is the baseline and shows nothing, whatever its number and however many batches bring it. A
    key first seen later grows by its whole value. A row whose poll is not after the last one of its key is late and
    dropped. A null reading shows no growth, and the next one grows from the last reading there was. A poll's row of a key that
    comes several times in the batch counts once, with its greatest readings.
    """
    kinds = _kinds(rows, spec, poll)
    rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds.fields])
    rows = rows.groupBy(*spec.keys, poll).agg(*[F.max(c).alias(c) for c in spec.counters])
    begin = (rows.agg(F.min(poll)) if state is None else state.agg(F.min("_first"))).first()[0]
    first = F.lit(begin).cast("bigint")
    both = rows.withColumn("_new", F.lit(1))
    if state is not None:
        both = both.unionByName(state.drop("_first").withColumn("_new", F.lit(0)))
    known = F.max(F.when(F.col("_new") == 0, F.col(poll))).over(Window.partitionBy(*spec.keys))
    late = (F.col("_new") == 1) & ((F.col(poll) <= F.col("_known")) | (F.col(poll) < first))
    both = both.withColumn("_known", known).withColumn("_late", F.coalesce(late, F.col(poll).isNull()))
    kept = both.filter("NOT _late")
    before = Window.partitionBy(*spec.keys).orderBy("_new", poll).rowsBetween(Window.unboundedPreceding, -1)
    grown = [(F.col(c) - F.coalesce(F.last(c, ignorenulls=True).over(before), F.lit(0))).alias(c) for c in spec.counters]
    deltas = kept.select(*spec.keys, poll, *grown, "_new").filter((F.col("_new") == 1) & (F.col(poll) > first)).drop("_new")
    newest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(poll))).alias(c) for c in spec.counters]
    last = kept.groupBy(*spec.keys).agg(F.max(poll).alias(poll), *newest).withColumn("_first", first)
    return deltas, last, both.filter("_late").select(*kinds.names)


def _at(folder: str, kind: str, number: int) -> str:
    return f"{folder}/{kind}/batch={number}"


def _started(polls: DataFrame, emit, checkpoint: str, poll_seconds: int | None) -> StreamingQuery:
    writer = polls.writeStream.foreachBatch(emit).option("checkpointLocation", checkpoint)
    if poll_seconds is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{poll_seconds} seconds").start()


def stream_counter_delta(
    polls: DataFrame, spec: CounterSpec, folder: str, checkpoint: str, poll: str = "snap_id",
    poll_seconds: int | None = DEFAULT_POLL_SECONDS, after=None,
) -> StreamingQuery:
    """Starts a query that writes the growth of every counter from poll to poll below ``folder``.

    ``polls`` is a stream with whole-number poll ids. ``deltas``, ``late`` and ``state`` hold one folder per batch; ``after`` is
    called with each batch's growth and number. Without ``poll_seconds`` the query stops at the end of its input.
    """

    def emit(batch: DataFrame, number: int) -> None:
        spark, schema = batch.sparkSession, _kinds(batch, spec, poll)
        state = None
        if number:
            state = spark.read.schema(T.StructType([*schema.fields, T.StructField("_first", T.LongType())])).parquet(_at(folder, "state", number - 1))
        batch = batch.persist()
        try:
            deltas, last, late = difference_batch(batch, state, spec, poll)
            last.write.mode("overwrite").parquet(_at(folder, "state", number))
            late.write.mode("overwrite").parquet(_at(folder, "late", number))
            deltas.write.mode("overwrite").parquet(_at(folder, "deltas", number))
            # The state before the last one is read by no batch any more, not even by one that is run again.
            remove_folder(spark, _at(folder, "state", number - 2))
            if after is not None:
                after(spark.read.schema(schema).parquet(_at(folder, "deltas", number)), number)
        finally:
            batch.unpersist()

    return _started(polls, emit, checkpoint, poll_seconds)


def read_deltas(spark: SparkSession, folder: str) -> DataFrame:
    """All growth that a query has written."""
    return spark.read.parquet(f"{folder}/deltas").drop("batch")


def count_late(spark: SparkSession, folder: str) -> DataFrame:
    """Late rows dropped, by poll."""
    return spark.read.parquet(f"{folder}/late")


def poll_report(deltas: DataFrame, spec: CounterSpec, poll: str = "snap_id", n: int = DEFAULT_TOP) -> DataFrame:
    """The ``n`` keys that grew most in every poll, smallest first, after detail keys are summed up."""
    sums = deltas.groupBy(poll, *spec.shown_keys).agg(*[F.sum(c).alias(c) for c in spec.counters])
    order = [F.col(spec.sort_by).desc(), *[F.col(k) for k in spec.shown_keys]]
    best = top_n_per_group(sums, [poll], order, n, "rank")
    return with_ratios(best, spec).orderBy(poll, F.col("rank").desc())


def stop_after(run, polls: int, wait_seconds: float = 0.2) -> None:
    """Lets a running query take ``polls`` micro-batches and stops it."""
    while run.isActive:
        done = run.lastProgress
        if done is not None and done["batchId"] + 1 >= polls:
            break
        run.awaitTermination(wait_seconds)
    run.stop()


def stream_top_polls(
    polls: DataFrame, spec: CounterSpec, folder: str, checkpoint: str, n: int = DEFAULT_TOP, poll: str = "snap_id",
    poll_seconds: int | None = DEFAULT_POLL_SECONDS,
) -> StreamingQuery:
    """As :func:`stream_counter_delta`, and keeps the top of every poll in ``top``, one folder per poll.

    A poll that several batches bring is ranked anew over the sums of these batches, so it has one list.
    """

    def rank(deltas: DataFrame, number: int) -> None:
        spark, sums = deltas.sparkSession, f"{folder}/sums"
        own = deltas.groupBy(poll, *spec.shown_keys).agg(*[F.sum(c).alias(c) for c in spec.counters]).withColumn("batch", F.lit(number))
        own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(poll, "batch").parquet(sums)
        touched = [row[0] for row in deltas.select(poll).distinct().collect()]
        if not touched:
            return
        # Only the sums of the polls that this batch brought are read, whatever has been written before.
        every = spark.read.schema(own.schema).option("basePath", sums).parquet(*[f"{sums}/{poll}={value}" for value in touched])
        report = poll_report(every, spec, poll, n)
        report.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(poll).parquet(f"{folder}/top")

    return stream_counter_delta(polls, spec, folder, checkpoint, poll, poll_seconds, rank)
