"""Column expressions shared by the operators and reports. All of them stay on the JVM side."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator`` with a zero denominator read as one."""
    return numerator.cast("double") / F.when(denominator == 0, F.lit(1)).otherwise(denominator)


def guarded_ratio(numerator: Column, denominator: Column, scale: float = 1.0) -> Column:
    """``scale * numerator / denominator``; zero unless the denominator is positive."""
    ratio = numerator.cast("double") * F.lit(float(scale)) / denominator
    return F.when(denominator > 0, ratio).otherwise(F.lit(0.0))


def exhaustion_pct(last: Column, low: Column, high: Column) -> Column:
    """Used share of a bounded number range, in percent with one decimal."""
    return F.round((last - low) * F.lit(100.0) / F.greatest(high - low, F.lit(1)), 1)


def duration_hms(seconds: Column) -> Column:
    """Whole seconds as ``HH:MM:SS``."""
    s = seconds.cast("bigint")
    return F.format_string(
        "%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    )


def duration_days_hms(seconds: Column) -> Column:
    """Whole seconds as ``N  Day  hh:mi:ss``."""
    s = seconds.cast("bigint")
    return F.concat_ws("  ", F.floor(s / 86400).cast("string"), F.lit("Day"), duration_hms(s % 86400))


def duration_minutes(seconds: Column) -> Column:
    """Seconds as minutes: one decimal below ten minutes, whole minutes from there on."""
    s = seconds.cast("bigint")
    return F.when(s < 600, F.format_string("%.1f", s / F.lit(60.0))).otherwise(
        F.floor(s / 60).cast("string")
    )


# Size units in the order they are tried.
SIZE_UNITS = ("bytes", "kB", "MB", "GB", "TB", "PB")


def fmt_bytes(size: Column) -> Column:
    """A byte count in the first unit that keeps it below 10240."""
    out = F.concat_ws(" ", _rounded(size, len(SIZE_UNITS) - 1), F.lit(SIZE_UNITS[-1]))
    for power in range(len(SIZE_UNITS) - 2, -1, -1):
        shown = _rounded(size, power)
        out = F.when(F.abs(shown) < 10240, F.concat_ws(" ", shown, F.lit(SIZE_UNITS[power]))).otherwise(out)
    return F.when(size.isNotNull(), out)


def _rounded(size: Column, power: int) -> Column:
    return F.round(size / F.lit(float(1024**power)), 0).cast("bigint")


def host_short(host: Column) -> Column:
    """The part of a host name before its first dot."""
    return F.substring_index(host, ".", 1)


def host_key(host: Column) -> Column:
    """Join key for host names written in mixed case, with or without a domain."""
    return F.lower(host_short(F.trim(host)))


def decode(value: Column, labels: Mapping, default: Column | str | None = None) -> Column:
    """Code to label; a None code matches a null value."""
    out = default if isinstance(default, Column) else F.lit(default)
    for code, label in reversed(list(labels.items())):
        out = F.when(value.eqNullSafe(F.lit(code)), F.lit(label)).otherwise(out)
    return out


def version_numbers(version: Column) -> Column:
    """The dotted numbers of a version as an integer array; arrays compare element by element."""
    return F.transform(
        F.split(F.substring_index(version, "-", 1), "[.]"), lambda part: part.try_cast("int")
    )


def version_suffix(version: Column) -> Column:
    """What follows the first dash of a version in lower case, or null."""
    return F.when(F.instr(version, "-") > 0, F.lower(F.regexp_extract(version, "-(.*)$", 1)))


def version_compare(left: Column, right: Column) -> Column:
    """-1, 0 or 1; null when a version is missing. A shorter version is lower; suffixes only break a tie."""
    a, b = version_numbers(left), version_numbers(right)
    sa = F.coalesce(version_suffix(left), F.lit(""))
    sb = F.coalesce(version_suffix(right), F.lit(""))
    order = F.when(a < b, -1).when(a > b, 1).when(sa < sb, -1).when(sa > sb, 1).otherwise(0)
    return F.when(left.isNotNull() & right.isNotNull(), order)


def version_at_least(version: Column, minimum: Column) -> Column:
    """True when ``version`` is ``minimum`` or later; false when it is missing."""
    return F.coalesce(version_compare(version, minimum) >= 0, F.lit(False))


def level(value: Column, warning: Column, critical: Column) -> Column:
    """0, 1 or 2 for a value against a warning and a critical limit, both inclusive."""
    return F.when(value >= critical, 2).when(value >= warning, 1).otherwise(0)


def unit_interval(key: Column, salt: str) -> Column:
    """A repeatable pseudo-random number in [0, 1) that depends on ``key`` and ``salt`` alone."""
    digest = F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(salt))), 1, 8)
    return F.conv(digest, 16, 10).cast("double") / F.lit(float(2**32))
