"""Threshold checks, classifications, version gates and readiness rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import version_at_least
from tidemark.operators.counters import SERIES, last_two_snapshots
from tidemark.operators.skew import lookup_join
from tidemark.specs import MINIMUM_VERSIONS, Rule


def wait_percent_check(
    events: DataFrame, model: DataFrame, snaps: DataFrame, names: Sequence[str] | None = None,
    warning: float = 60, critical: float = 90,
) -> DataFrame:
    """Waits between the last two snapshots as a share of database time, or of the clock when that is larger.

    One row per instance and event. ``events`` has ``event_name`` and ``time_waited_micro``; ``model`` has
    ``stat_name`` and ``value`` and answers for names that are no events. With ``names`` only those are looked
    for, and one that is missing is reported as UNKNOWN, as is an instance with fewer than two snapshots since
    its start.
    """
    if warning > critical:
        raise ValueError("the warning level must not exceed the critical level")
    # Snapshots per start time, then the number at the newest start: two small aggregates.
    starts = snaps.groupBy(*SERIES, "startup_time").agg(F.count("*").alias("n"))
    since_start = starts.groupBy(*SERIES).agg(F.max_by("n", "startup_time").alias("_snaps"))
    two = last_two_snapshots(snaps).select(
        *SERIES, "snap_id", "age",
        F.timestamp_diff("SECOND", F.col("begin_interval_time"), F.col("end_interval_time")).cast("double").alias("seconds"),
    )
    elapsed = two.filter("age = 1").select(*SERIES, F.col("seconds").alias("elapsed_sec"))

    def readings(df: DataFrame, name: str, value: str, source: int) -> DataFrame:
        rows = df.select(*SERIES, "snap_id", F.lower(name).alias("name"), F.col(value).cast("double").alias("value"), F.lit(source).alias("source"))
        if names is None:
            return rows
        return rows.filter(F.col("name").isin(*{n.lower() for n in names}, "db time"))

    # Events and time model together meet the two snapshots once and are reduced by one aggregate.
    both = readings(events, "event_name", "time_waited_micro", 1).unionByName(readings(model, "stat_name", "value", 2))
    picked = lookup_join(both, two.select(*SERIES, "snap_id", "age"), [*SERIES, "snap_id"], "inner")

    def change(source: int) -> Column:
        at = [F.max(F.when((F.col("age") == age) & (F.col("source") == source), F.col("value"))) for age in (1, 2)]
        return (at[0] - at[1]) / F.lit(1e6)

    found = picked.groupBy(*SERIES, "name").agg(change(1).alias("_event"), change(2).alias("_model"))
    waits = found.select(*SERIES, "name", F.round(F.coalesce("_event", "_model"), 2).alias("wait_sec")).filter("wait_sec IS NOT NULL")
    db_time = found.filter("name = 'db time' AND _model IS NOT NULL").select(*SERIES, F.col("_model").alias("db_sec"))
    instances = elapsed.join(since_start, list(SERIES), "left").join(db_time, list(SERIES), "left")
    if names is None:
        rows = waits.join(instances, list(SERIES))
    else:
        asked = F.explode(F.array(*[F.lit(n.lower()) for n in names]))
        rows = instances.withColumn("name", asked).join(waits, [*SERIES, "name"], "left")
    base = F.when(F.col("db_sec") * 2 > F.col("elapsed_sec"), F.col("db_sec")).otherwise(F.col("elapsed_sec"))
    pct = F.col("wait_pct")
    status = (
        F.when((F.coalesce("_snaps", F.lit(0)) < 2) | pct.isNull(), "UNKNOWN")
        .when(pct > critical, "CRITICAL").when(pct >= warning, "WARNING").otherwise("OK")
    )
    scored = rows.withColumn("wait_pct", F.round(F.col("wait_sec") / base * 100, 2))
    return scored.select(*SERIES, "name", "wait_sec", "elapsed_sec", "db_sec", "wait_pct", status.alias("status"))


# Names of the severity levels by exit code.
SEVERITY = {0: "OK", 1: "WARNING", 2: "CRITICAL"}


def replication_health(status: DataFrame) -> DataFrame:
    """Severity of each replica from its thread states, lag and last error."""

    def thread(state: str) -> Column:
        value = F.lower(F.coalesce(F.col(state), F.lit("")))
        return F.when(value == "yes", 0).when(value == "no", 2).otherwise(1)

    lag = F.col("seconds_behind").try_cast("bigint")
    behind = F.when(lag > 30, 2).when(lag > 0, 1).otherwise(0)
    failed = F.when(F.trim(F.coalesce("last_error", F.lit(""))) != "", 2).otherwise(0)
    code = F.greatest(thread("io_running"), thread("sql_running"), behind, failed)
    labels = F.when(code == 2, SEVERITY[2]).when(code == 1, SEVERITY[1]).otherwise(SEVERITY[0])
    return status.select("host", lag.alias("lag_seconds"), code.alias("exit_code"), labels.alias("status"))


def sequence_gap(df: DataFrame, limit: int = 5) -> DataFrame:
    """Archived minus applied log sequence per thread; an error when too far apart or one side is missing."""
    archived = F.max(F.when((F.col("dest_id") == 1) & (F.col("archived") == "YES"), F.col("sequence_no")))
    arrived = (F.col("dest_id") == 2) & (F.col("applied") == "YES")
    sums = df.groupBy("thread_no").agg(
        archived.alias("log_archived"), F.max(F.when(arrived, F.col("sequence_no"))).alias("log_applied"),
        F.max(F.when(arrived, F.col("completion_time"))).alias("applied_time"),
    )
    gap = F.col("log_archived") - F.col("log_applied")
    wrong = (gap > limit) | (F.col("applied_time").isNull() != gap.isNull())
    return sums.select(
        "thread_no", "applied_time", gap.alias("log_gap"),
        F.when(wrong, "Error! Log Gap is ").otherwise("OK!").alias("status"),
    )


def version_gate(versions: DataFrame, minimums: Mapping[str, str] = MINIMUM_VERSIONS) -> DataFrame:
    """Whether each component has at least the version asked for its type; types without a rule are left out."""
    required = F.lit(None).cast("string")
    for kind, least in minimums.items():
        required = F.when(F.col("type") == kind, F.lit(least)).otherwise(required)
    ruled = versions.withColumn("required", required).filter("required IS NOT NULL")
    return ruled.withColumn("passed", version_at_least(F.col("version"), F.col("required")))


COMPARISONS = {
    "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "=": lambda a, b: a == b,
    ">=": lambda a, b: a >= b, ">": lambda a, b: a > b,
}


def gate(observations: Sequence[tuple[Rule, DataFrame]]) -> DataFrame:
    """One row per rule from frames of one number each: what was seen, what is required, and the verdict."""

    def judge(rule: Rule, seen: DataFrame) -> DataFrame:
        observed = F.col("seen").cast("double")
        required = F.lit(float(rule.required))
        verdict = F.coalesce(COMPARISONS[rule.comparison](observed, required), F.lit(False))
        return seen.toDF("seen").select(
            F.lit(rule.name).alias("rule"), observed.alias("observed"), F.lit(rule.comparison).alias("comparison"),
            required.alias("required"), verdict.alias("passed"),
        )

    return reduce(DataFrame.unionByName, [judge(rule, seen) for rule, seen in observations])


def gate_scan(scans: Sequence[tuple[DataFrame, Sequence[tuple[Rule, Column]]]]) -> DataFrame:
    """As :func:`gate` for rules over the same tables: each table comes with its rules and what each of them observes, an
    aggregate over it. All rules of a table are answered by one pass over it; a condition of a rule goes into its aggregate."""

    def judged(table: DataFrame, rules: Sequence[tuple[Rule, Column]]) -> DataFrame:
        seen = table.agg(*[observed.cast("double").alias(f"r{k}") for k, (_, observed) in enumerate(rules)])
        rows = [
            F.struct(
                F.lit(rule.name).alias("rule"), F.col(f"r{k}").alias("observed"), F.lit(rule.comparison).alias("comparison"),
                F.lit(float(rule.required)).alias("required"),
                F.coalesce(COMPARISONS[rule.comparison](F.col(f"r{k}"), F.lit(float(rule.required))), F.lit(False)).alias("passed"),
            )
            for k, (rule, _) in enumerate(rules)
        ]
        return seen.select(F.inline(F.array(*rows)))

    return reduce(DataFrame.unionByName, [judged(table, rules) for table, rules in scans])


def first_match(line: Column, patterns: Sequence[str], position: Column) -> Column:
    """Aggregate: capture 1 of the newest line that fits the first pattern, else of the next pattern, and so on."""
    tries = []
    for pattern in patterns:
        captured = F.when(line.rlike(pattern), F.regexp_extract(line, pattern, 1))
        found = F.when(captured != "", captured)
        tries.append(F.max_by(found, F.when(found.isNotNull(), position)))
    return F.coalesce(*tries)


def host_mapping_audit(declared: DataFrame, resolved: DataFrame) -> DataFrame:
    """Declared host, address and domain against what name resolution returned."""
    seen = resolved.select(
        "host_name", F.col("ip").alias("resolved_ip"), F.col("domain").alias("resolved_domain")
    )
    joined = declared.join(seen, "host_name", "left")
    verdict = (
        F.when(F.col("resolved_ip").isNull(), "unresolved")
        .when(F.col("resolved_ip") != F.col("ip"), "address differs")
        .when(F.lower("resolved_domain") != F.lower("domain"), "domain differs")
        .otherwise("ok")
    )
    return joined.select("host_name", "ip", "resolved_ip", "domain", "resolved_domain", verdict.alias("verdict"))


def domain_audit(domains: DataFrame) -> DataFrame:
    """Whether the domain found by lookup (``found``) and the one set on the host (``configured``) agree."""

    def known(name: str) -> Column:
        text = F.trim(F.coalesce(F.col(name), F.lit("")))
        return F.when((text == "") | text.contains("(none)"), "").otherwise(text)

    found, configured = known("found"), known("configured")
    verdict = (
        F.when((found == "") & (configured == ""), "both empty").when(found == configured, "same")
        .when(found == "", "found empty").when(configured == "", "configured empty").otherwise("different")
    )
    judged = domains.withColumn("verdict", verdict)
    return judged.withColumn("passed", F.col("verdict").isin("same", "configured empty"))


def cipher_audit(nodes: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Whether a node offers at least one expected cipher; ``ciphers`` is a list joined by commas."""
    offered = F.split(F.regexp_replace("ciphers", "[ \t]", ""), ",")
    wanted = F.array(*[F.lit(c) for c in expected])
    common = F.array_sort(F.array_intersect(offered, wanted))
    return nodes.select(
        "node", F.array_join(common, ",").alias("matching"), (F.size(common) > 0).alias("passed")
    )
