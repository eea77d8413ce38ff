"""Changing rows of a partitioned table in place."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.skew import bounded
from tidemark.session import written


@dataclass(frozen=True)
class Rewritten:
    """Partitions that were written anew, and of these the ones that no row is left of and that were removed."""

    replaced: int
    removed: int


def _folders(rows: DataFrame, parts: Sequence[str]) -> DataFrame:
    return rows.select(*parts).distinct()


def rewrite_partitions(
    spark: SparkSession, folder: str, schema: T.StructType, parts: Sequence[str], wanted: Column, change: Callable[[DataFrame], DataFrame]
) -> Rewritten:
    """Applies ``change`` to the partitions of a Parquet table that hold a row to which ``wanted`` applies, and to no other.

    ``change`` gets all rows of these partitions and returns what they shall hold; it must keep the rows in their partitions.
    The new rows are staged in the shared folder first, then each partition is replaced by its new files, and one of which
    no row is left is removed. The files of other partitions are not touched. If no row is wanted nothing is written, so a
    change that leaves no wanted rows can be run again; a run that was cut off is made good by running it again.
    """
    table = spark.read.schema(schema).option("basePath", folder).parquet(folder)
    touched = written(_folders(table.filter(wanted), parts), "touched")
    count = touched.count()
    if not count:
        return Rewritten(0, 0)
    known = [F.col(p).eqNullSafe(F.col(f"_{p}")) for p in parts]
    condition = known[0]
    for more in known[1:]:
        condition = condition & more
    ahead = bounded(touched.select(*[F.col(p).alias(f"_{p}") for p in parts]), 64)
    staged = written(change(table.join(ahead, condition, "left_semi")), "staged")
    left = _folders(staged, parts)
    stray = left.exceptAll(touched.select(*parts)).limit(1).count()
    if stray:
        raise ValueError("the change moves rows to other partitions")
    emptied = touched.exceptAll(left)
    staged.select(*schema.names).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(folder)
    # Folder names as Spark writes them: a partition without rows is replaced by none, so it is removed here.
    escaped = F.concat_ws("/", *[
        F.concat(F.lit(f"{p}="), F.coalesce(_escaped(F.col(p).cast("string")), F.lit("__HIVE_DEFAULT_PARTITION__"))) for p in parts
    ])
    removed = 0
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for row in emptied.select(escaped.alias("name")).toLocalIterator():
        path = hadoop(f"{folder}/{row['name']}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        removed += 1
    return Rewritten(count - removed, removed)


# Characters that Spark writes as %XX in the names of partition folders.
ESCAPED = "\"#%'*/:=?\\\x7F{[]^"


def _escaped(value: Column) -> Column:
    for char in ["%", *[c for c in ESCAPED if c != "%"], *map(chr, range(1, 32))]:
        value = F.replace(value, F.lit(char), F.lit(f"%{ord(char):02X}"))
    return value
