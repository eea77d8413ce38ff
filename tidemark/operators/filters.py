"""Row selection: time windows, user-given patterns, instance choice."""

from __future__ import annotations

import datetime
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_ntz(moment: str | datetime.datetime) -> Column:
    """A literal timestamp without zone."""
    return F.lit(str(moment)).cast("timestamp_ntz")


def trailing_window(ts: Column, as_of: Column, seconds: int) -> Column:
    """True from ``seconds`` before ``as_of`` up to ``as_of``, both inclusive."""
    return ts.between(as_of - F.expr(f"INTERVAL '{int(seconds)}' SECOND"), as_of)


def since(ts: Column, as_of: Column, seconds: int) -> Column:
    """True later than ``seconds`` before ``as_of``, and not after ``as_of``."""
    return (ts > as_of - F.expr(f"INTERVAL '{int(seconds)}' SECOND")) & (ts <= as_of)


def same_day(ts: Column, as_of: str | datetime.datetime) -> Column:
    """True on the calendar day of ``as_of``, as a half-open range that a scan can use for pruning."""
    start = datetime.datetime.fromisoformat(str(as_of)).replace(hour=0, minute=0, second=0, microsecond=0)
    return (ts >= as_ntz(start)) & (ts < as_ntz(start + datetime.timedelta(days=1)))


def like_filters(df: DataFrame, patterns: Mapping[str, str | None]) -> DataFrame:
    """Keeps rows that match every given LIKE pattern; an empty pattern means all rows."""
    unknown = set(patterns) - set(df.columns)
    if unknown:
        raise ValueError(f"no such column: {sorted(unknown)}")
    condition = F.lit(True)
    for column, pattern in patterns.items():
        if pattern:
            condition = condition & F.col(column).like(pattern)
    return df.filter(condition)


def choose_instances(
    df: DataFrame, names: Mapping[str, int], choice: str | Sequence[str], current: str | None = None
) -> DataFrame:
    """Rows of ``ALL`` instances, of the ``CURRENT`` one, or of those named; an unknown name is an error."""
    if choice == "ALL":
        return df
    wanted = [current] if choice == "CURRENT" else ([choice] if isinstance(choice, str) else list(choice))
    known = {name.lower(): inst for name, inst in names.items()}
    missing = [name for name in wanted if name is None or name.lower() not in known]
    if missing:
        raise ValueError(f"no such instance: {missing}")
    return df.filter(F.col("inst_id").isin([known[name.lower()] for name in wanted]))


def exclude_values(df: DataFrame, column: str, values: Sequence[str | None]) -> DataFrame:
    """Rows whose ``column`` is none of ``values``, as NOT IN says it, for lists of any length.

    A null row is never kept, and a null among ``values`` leaves no row. An empty list keeps every row.
    """
    if not values:
        return df
    if any(v is None for v in values):
        return df.filter(F.lit(False))
    return df.filter(~F.col(column).isin(list(values)))
