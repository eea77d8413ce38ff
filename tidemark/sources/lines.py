"""Numbered lines from log and command output files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.session import work_folder

#: Entries of the table of splits that are sent to every executor; beyond it the lines are joined to it.
MOST_SENT_SPLITS = 2_000_000

#: The last folder of the path is the node, the rest the file.
NODE_AND_FILE = r"([^/]+)/([^/]+)$"


def read_log_files(
    spark: SparkSession, paths: str | list[str], folder: str | None = None, layout: str = NODE_AND_FILE,
    split_bytes: int | None = None, most_sent: int = MOST_SENT_SPLITS,
) -> DataFrame:
    """(node, file, log, rotation, line_no, line) of text files, whole folders and globs included; ``.gz`` files are unpacked.

    Lines are numbered from 1 within their file, exactly, although a large file is read as splits by many tasks. A task reads
    the lines of a split in order and counts them; a running sum over the splits of each file, one row each, tells how many
    lines stand before every split. The lines are landed as Parquet in ``folder`` (by default below the shared folder) with
    their place in the split, so that later reads, filtered ones too, see the same numbers.

    ``layout`` has a group for the node and one for the file, matched at the end of the path. ``file`` is that name as it is;
    ``log`` is the name without what rotation appends (``.1``, ``.2.gz``) and ``rotation`` that number, 0 for the current
    file. An empty file has no lines. A last line without an end counts; line ends are LF, CR LF or CR.
    ``split_bytes`` is the largest split, by default that of the session.
    """
    folder = folder or work_folder(spark, "lines")
    reader = spark
    if split_bytes is not None:
        # Another session of the same application, so that the caller's settings stay as they are.
        reader = spark.newSession()
        reader.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
        reader.conf.set("spark.sql.files.openCostInBytes", str(min(split_bytes, 4 << 20)))
    raw = reader.read.text(paths).select(
        F.col("value").alias("line"), F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("path"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("place"),
    )
    raw.write.parquet(f"{folder}/read")
    landed = spark.read.schema(raw.schema).parquet(f"{folder}/read")
    splits = landed.groupBy("path", "split").agg(F.min("place").alias("first"), F.count("*").alias("lines"))
    before = F.sum("lines").over(Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    # A number takes the place of the path in what is sent: the hash of the path and the split.
    splits = splits.withColumn("base", F.coalesce(before, F.lit(0)) - F.col("first") + 1).select("path", "split", "base")
    splits.write.parquet(f"{folder}/splits")
    known = spark.read.schema(splits.schema).parquet(f"{folder}/splits")
    if known.count() <= most_sent:
        known = F.broadcast(known)
    name = F.regexp_extract("path", layout, 2)
    rotated = r"^(.*?)(?:\.(\d+))?(?:\.gz)?$"
    return landed.join(known, ["path", "split"]).select(
        F.regexp_extract("path", layout, 1).alias("node"), name.alias("file"), F.regexp_extract(name, rotated, 1).alias("log"),
        F.coalesce(F.regexp_extract(name, rotated, 2).try_cast("int"), F.lit(0)).alias("rotation"),
        (F.col("place") + F.col("base")).alias("line_no"), "line",
    )


def newest(lines: DataFrame):
    """The order of the lines of a node: by time stamp, where there are such, then by file, the current one last, and line.

    Stamps come from a column ``logged_at``, files from ``rotation`` and ``file``; each counts where ``lines`` has it. Line
    numbers say nothing about lines of different files.
    """
    given = [F.col(c) for c in ("logged_at",) if c in lines.columns]
    given += [(-F.col(c)).alias(c) for c in ("rotation",) if c in lines.columns]
    return F.struct(*given, *[F.col(c) for c in ("file", "line_no") if c in lines.columns])
