"""The fleet scorecard: one row of health figures per monitored database.

The metric table is read once. A first aggregate reduces the day's samples of every series (entity, metric,
key) to last value, extremes and sum; every figure of the scorecard is taken from that reduced frame.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import host_key, level
from tidemark.operators.filters import same_day
from tidemark.operators.joins import longest_prefix, threshold_fallback
from tidemark.operators.ranking import top_n_per_group
from tidemark.operators.skew import lookup_join
from tidemark.session import written

# Entity types and metric names.
DATABASE_TYPES = ("oracle_database", "oracle_pdb")
HOST_METRICS = {
    "cpu": "CPU Utilization (%)",
    "swap": "Swap Utilization (%)",
    "iops": "Total Disk I/O made across all disks (per second)",
}
TABLESPACE_USED = "Tablespace Space Used (%)"
FILESYSTEM_FREE = "Filesystem Space Available (%)"
WAIT_SECONDS = "Total Foreground Wait Time (second)"
WAIT_CLASS = "Database Time Spent Waiting (%)"
APPLY_LAG = "Apply Lag (seconds)"
TRANSPORT_LAG = "Transport Lag (seconds)"
LABELS = (*HOST_METRICS.values(), TABLESPACE_USED, FILESYSTEM_FREE, WAIT_SECONDS, WAIT_CLASS)


def target_list(properties: DataFrame) -> DataFrame:
    """Targets with the short name of their host."""
    return properties.select("target_name", host_key(F.col("machine_name")).alias("host"))


def day_series(metrics: DataFrame, as_of: str) -> DataFrame:
    """The samples of one day reduced to one row per series."""
    day = metrics.filter(same_day(F.col("collection_time"), as_of) & F.col("metric_column_label").isin(*LABELS))
    return day.groupBy("entity_name", "entity_type", "metric_column_label", "metric_key_value").agg(
        F.max_by("value", "collection_time").alias("last"), F.max("collection_time").alias("last_time"),
        F.max("value").alias("high"), F.sum(F.col("value").cast("decimal(18,6)")).alias("total"), F.count("value").alias("n"),
    )


def host_figures(series: DataFrame) -> DataFrame:
    """Greatest and mean value of each host metric, one row per host."""
    rows = series.filter((F.col("entity_type") == "host") & F.col("metric_column_label").isin(*HOST_METRICS.values()))
    by_host = rows.withColumn("host", host_key(F.col("entity_name"))).groupBy("host")

    def of(label: str, value: Column) -> Column:
        return F.when(F.col("metric_column_label") == label, value)

    figures = []
    for name, label in HOST_METRICS.items():
        # Divided as decimals, so that a mean halfway between two steps rounds up.
        mean = F.round(F.sum(of(label, F.col("total"))) / F.sum(of(label, F.col("n"))), 1).cast("double")
        figures += [F.round(F.max(of(label, F.col("high"))), 1).alias(f"{name}_max_pc"), mean.alias(f"{name}_avg_pc")]
    return by_host.agg(*figures)


def tablespace_use(series: DataFrame) -> DataFrame:
    """Last use of every tablespace, in percent."""
    rows = series.filter(
        F.col("entity_type").isin(*DATABASE_TYPES) & (F.col("metric_column_label") == TABLESPACE_USED)
    )
    return rows.groupBy(F.col("entity_name").alias("target_name"), F.col("metric_key_value").alias("key_value")).agg(
        F.max_by("last", "last_time").alias("used")
    )


def tablespace_level(use: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Worst level of any tablespace of a target; tablespaces without any limit do not count."""
    limits = ["warning_threshold", "critical_threshold"]
    usable = thresholds.filter(
        (F.trim("warning_threshold") != "") & (F.trim("critical_threshold") != "")
    )
    limited = threshold_fallback(use, usable, "target_name", "key_value", limits).filter("warning_threshold IS NOT NULL")
    value = F.round(F.col("used"), 1)
    return limited.groupBy("target_name").agg(
        F.max(level(value, F.col("warning_threshold"), F.col("critical_threshold"))).alias("usage_level")
    )


def filesystem_use(series: DataFrame) -> DataFrame:
    """Last use of every file system of every host, in percent; the root file system is left out."""
    rows = series.filter(
        (F.col("entity_type") == "host") & (F.col("metric_column_label") == FILESYSTEM_FREE) & (F.col("metric_key_value") != "/")
    )
    latest = rows.groupBy(host_key(F.col("entity_name")).alias("host"), F.col("metric_key_value").alias("mount")).agg(
        F.max_by("last", "last_time").alias("free")
    )
    return latest.select("host", "mount", (F.lit(100) - F.col("free")).alias("used"))


def data_filesystems(use: DataFrame, datafiles: DataFrame) -> DataFrame:
    """Fullest file system that holds data files of a target."""
    on_disk = F.col("file_name").startswith("/")
    mount = F.when(on_disk, F.col("os_storage_entity")).otherwise(F.substring("file_name", 1, 3))
    places = datafiles.select("target_name", host_key(F.col("host_name")).alias("host"), mount.alias("mount")).distinct()
    found = lookup_join(places, use, ["host", "mount"], "inner")
    return found.groupBy("target_name").agg(F.round(F.max("used"), 1).alias("data_fs_max_pc"))


def archive_filesystems(use: DataFrame, parameters: DataFrame) -> DataFrame:
    """Use of the file system with the longest mount point that holds an archive or recovery area of a target."""
    name, value = F.col("name"), F.col("value")
    kept = parameters.filter(
        ((name.like("log_archive_dest%") & ~name.like("log_archive_dest_state%")) | (name == "db_recovery_file_dest"))
        & (F.length("value") > 0) & ~F.upper(value).like("SERVICE=%") & ~F.upper(value).like("%USE_DB_RECOVERY_FILE_DEST%")
    )
    bare = F.regexp_replace(value, "(?i)^LOCATION=", "")
    sid = F.substring_index("target_name", "_", 1)
    paths = kept.select(
        "target_name", "name", host_key(F.col("host_name")).alias("host"),
        F.replace(bare, F.lit("$ORACLE_SID"), sid).alias("path"),
    )
    found = longest_prefix(paths, use, ["target_name", "name"], "path", "mount", ["host"])
    longest = found.groupBy("target_name").agg(
        F.max_by(F.struct("host", "mount"), F.struct(F.length("mount"), "mount")).alias("_m")
    ).select("target_name", "_m.host", "_m.mount")
    used = lookup_join(longest, use, ["host", "mount"], "inner")
    return used.select("target_name", F.round("used", 1).alias("arch_fra_fs_max_pc"))


def top_wait(series: DataFrame) -> DataFrame:
    """The wait event and the wait class with the greatest mean, as ``event (class)``."""
    def leader(label: str, name: str) -> DataFrame:
        rows = series.filter(F.col("entity_type").isin(*DATABASE_TYPES) & (F.col("metric_column_label") == label))
        means = rows.groupBy(F.col("entity_name").alias("target_name"), "metric_key_value").agg(
            F.round(F.sum("total") / F.sum("n"), 1).alias("mean")
        )
        best = top_n_per_group(means, ["target_name"], [F.col("mean").desc(), F.col("metric_key_value")], 1)
        return best.select("target_name", F.col("metric_key_value").alias(name))

    both = leader(WAIT_SECONDS, "event").join(leader(WAIT_CLASS, "class"), "target_name")
    return both.select("target_name", F.format_string("%s (%s)", "event", "class").alias("top_db_wait"))


def standby_lag(standby: DataFrame) -> DataFrame:
    """Apply and transport lag side by side."""
    seconds = F.col("value").try_cast("double")
    return standby.groupBy("target_name").agg(
        F.max(F.when(F.col("column_label") == APPLY_LAG, seconds)).alias("apply_lag_sec"),
        F.max(F.when(F.col("column_label") == TRANSPORT_LAG, seconds)).alias("transport_lag_sec"),
    )


def scorecard(
    properties: DataFrame, metrics: DataFrame, thresholds: DataFrame, datafiles: DataFrame, parameters: DataFrame,
    standby: DataFrame, as_of: str, how: str = "inner",
) -> DataFrame:
    """All figures per target. With ``how='left'`` targets whose host has no samples stay in."""
    targets = target_list(properties)
    # Written once: otherwise every figure below would read the metric table again with a filter of its own.
    series = written(day_series(metrics, as_of), "fleet-series")
    hosts = host_figures(series)
    if how == "inner":
        hosts = hosts.dropna(subset=[f"{name}_max_pc" for name in HOST_METRICS])
    use = tablespace_use(series)
    fullest = use.groupBy("target_name").agg(F.round(F.max("used"), 1).alias("tbs_max_pc"))
    filesystems = filesystem_use(series)
    parts = [
        fullest, tablespace_level(use, thresholds), data_filesystems(filesystems, datafiles),
        archive_filesystems(filesystems, parameters), standby_lag(standby), top_wait(series),
    ]
    # One row per target and part, brought together by one aggregate instead of a join for each part.
    kinds = {f.name: f.dataType for part in parts for f in part.schema.fields if f.name != "target_name"}
    wide = [
        part.select("target_name", *[F.col(c) if c in part.columns else F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()])
        for part in parts
    ]
    figures = reduce(DataFrame.unionByName, wide).groupBy("target_name").agg(*[F.max(c).alias(c) for c in kinds])
    return lookup_join(targets, hosts, ["host"], how).join(figures, "target_name", "left").orderBy("target_name")
