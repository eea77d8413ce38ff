"""Readiness gates: what must hold before an upgrade, and what to look at after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import version_compare
from tidemark.operators.checks import gate
from tidemark.operators.skew import lookup_join
from tidemark.specs import Rule

MB = 1024 * 1024


def backup_age(backups: DataFrame, datafiles: DataFrame, as_of: Column) -> DataFrame:
    """Worst age of the newest full and the newest incremental backup over all files that have both."""
    named = lookup_join(backups, datafiles, ["file_no"], "inner")
    level = F.col("incremental_level")
    newest = named.groupBy("name").agg(
        F.max(F.when(level == 0, F.col("completion_time"))).alias("full_time"),
        F.max(F.when(level > 0, F.col("completion_time"))).alias("incr_time"),
    ).filter("full_time IS NOT NULL AND incr_time IS NOT NULL")

    def worst(name: str) -> DataFrame:
        days = F.round(F.timestamp_diff("SECOND", F.col(name), as_of) / 86400.0, 2)
        return newest.agg(F.round(F.max(days), 0))

    return gate([
        (Rule("full backup age in days", "<=", 6), worst("full_time")),
        (Rule("incremental backup age in days", "<=", 2), worst("incr_time")),
    ])


def release_check(reported: DataFrame, recorded: DataFrame, target: str) -> DataFrame:
    """Per database: the recorded release equals the reported one, and the target is higher than both."""
    joined = reported.join(recorded.withColumnRenamed("version", "recorded"), "name")
    goal = F.lit(target)
    agrees = version_compare(F.col("version"), F.col("recorded")) == 0
    higher = (version_compare(goal, F.col("version")) > 0) & (version_compare(goal, F.col("recorded")) > 0)
    return joined.select(
        "name", F.col("version").alias("reported"), "recorded", goal.alias("target"), agrees.alias("agrees"),
        higher.alias("target_is_higher"), (agrees & higher).alias("passed"),
    )


def pool_size(settings: DataFrame) -> DataFrame:
    """Current pool size in MB against what cache size and process count call for; ``settings`` is (name, value)."""
    def value(name: str) -> Column:
        return F.sum(F.when(F.col("name") == name, F.col("value")))

    row = settings.agg(
        (value("pool") / MB).alias("current_mb"), (value("cache") / MB).alias("cache_mb"), value("processes").alias("processes")
    )
    required = 80 + 15 * (F.col("cache_mb") / 256) + 5 * (F.col("processes") / 100)
    return row.select("current_mb", required.alias("required_mb")).withColumn("passed", F.col("current_mb") > F.col("required_mb"))


def journal_objects(objects: DataFrame, flags: DataFrame) -> DataFrame:
    """Number of journal objects, with how many belong to a rebuilt index and how many have their own index."""
    journals = objects.filter("object_name LIKE 'JOURNAL/_%' ESCAPE '/'").select(
        F.col("object_name").alias("jname"), F.concat(F.lit("TOP_"), "object_id").alias("iotname")
    )
    rebuilt = flags.filter(F.col("flags").bitwiseAND(512) == 512).select(
        F.concat(F.lit("JOURNAL_"), "object_id").alias("jname"), F.lit(1).alias("rebuilt")
    ).distinct()
    tops = objects.filter("object_name LIKE 'TOP/_%' ESCAPE '/'").select(
        F.col("object_name").alias("iotname"), F.lit(1).alias("top")
    ).distinct()
    joined = journals.join(rebuilt, "jname", "left").join(tops, "iotname", "left")
    return joined.agg(
        F.count("*").alias("journals"), F.count("rebuilt").alias("rebuilt"), F.count("top").alias("with_top"),
        (F.count("*") == 0).alias("passed"),
    )


def count_limits(props: DataFrame, corruption: DataFrame, restore_points: DataFrame) -> DataFrame:
    """At most one settings row, no corrupt blocks, no guaranteed restore points."""
    return gate([
        (Rule("settings rows", "<=", 1), props.agg(F.count("*"))),
        (Rule("corrupt blocks", "=", 0), corruption.agg(F.count("*"))),
        (Rule("guaranteed restore points", "=", 0), restore_points.agg(F.count("*"))),
    ])


def space_limits(files: DataFrame, statistics_tables: DataFrame) -> DataFrame:
    """At least 5 GB of space, and no statistics table above 512 MB."""
    sizes = statistics_tables.groupBy("segment_name").agg(F.sum("bytes").alias("bytes"))
    return gate([
        (Rule("space in MB", ">=", 5 * 1024), files.agg(F.sum("bytes") / MB)),
        (Rule("statistics tables above 512 MB", "=", 0), sizes.filter(F.col("bytes") / MB > 512).agg(F.count("*"))),
    ])


# Time zone file versions that an upgrade accepts.
TIME_ZONE_VERSIONS = (4, 14)


def time_zone(versions: DataFrame) -> DataFrame:
    return versions.withColumn("passed", F.col("version").isin(*TIME_ZONE_VERSIONS))


def after_run(objects: DataFrame, indexes: DataFrame) -> DataFrame:
    """Invalid objects, distinct names among them, and indexes by status."""
    invalid = objects.filter("status = 'INVALID'").agg(
        F.count("*").alias("n"), F.count_distinct("owner", "object_type").alias("kinds")
    )
    rows = invalid.select(F.explode(F.array(
        F.struct(F.lit("invalid objects").alias("item"), F.col("n")),
        F.struct(F.lit("invalid object kinds").alias("item"), F.col("kinds").alias("n")),
    )).alias("r")).select("r.*")
    by_status = indexes.groupBy(F.concat(F.lit("indexes "), "status").alias("item")).agg(F.count("*").alias("n"))
    return rows.unionByName(by_status)
