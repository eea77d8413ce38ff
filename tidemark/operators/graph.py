"""Who waits for whom."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranking import top_n, top_n_per_group
from tidemark.operators.skew import lookup_join
from tidemark.session import written


def blocking_tree(edges: DataFrame) -> DataFrame:
    """All waiters below the blockers that wait for nobody, one row each, listed depth first.

    ``edges`` are ``(blocker, waiter)`` strings and a waiter has one blocker. Every row knows an ancestor and
    the path from it. Each round replaces the ancestor by the ancestor's ancestor, so the distance doubles and
    the number of rounds is the logarithm of the depth. Waits in a circle never reach a root and are left out.
    Columns: ``lock_tree`` (indented), ``waiter``, ``level``, ``root``, ``path`` (sort by it for the listing).
    """
    waiters = edges.groupBy("waiter").agg(F.min("blocker").alias("blocker"))
    roots = (
        waiters.select(F.col("blocker").alias("waiter")).distinct().join(waiters, "waiter", "left_anti")
    )
    settled = roots.select(
        "waiter", F.col("waiter").alias("top"), F.lit(1).alias("level"), F.array("waiter").alias("path")
    )
    open_rows = waiters.select(
        "waiter", F.col("blocker").alias("top"), F.lit(1).alias("steps"), F.array("waiter").alias("path")
    )
    settled = written(settled, "tree-roots")
    open_rows = written(open_rows, "tree-open")
    parts = [settled]
    waiting = open_rows.count()
    while waiting:
        # Rows whose ancestor is settled already are finished with it.
        known = settled_tops(parts)
        arrived = lookup_join(
            open_rows, known.select(F.col("waiter").alias("top"), F.col("top").alias("_root"),
                                    F.col("level").alias("_level"), F.col("path").alias("_path")),
            ["top"], "left",
        )
        arrived = written(arrived, "tree-step")
        done = arrived.filter("_root IS NOT NULL").select(
            "waiter", F.col("_root").alias("top"), (F.col("_level") + F.col("steps")).alias("level"),
            F.concat("_path", "path").alias("path"),
        )
        rest = arrived.filter("_root IS NULL").select("waiter", "top", "steps", "path")
        parts.append(done)
        jumps = rest.select(
            F.col("waiter").alias("top"), F.col("top").alias("_next"), F.col("steps").alias("_steps"),
            F.col("path").alias("_path"),
        )
        # An ancestor that was finished in this round has no jump; its rows finish in the next one.
        open_rows = written(
            lookup_join(rest, jumps, ["top"], "left").select(
                "waiter", F.coalesce("_next", "top").alias("top"),
                (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"),
                F.when(F.col("_path").isNull(), F.col("path")).otherwise(F.concat("_path", "path")).alias("path"),
            ),
            "tree-open",
        )
        left = open_rows.count()
        if left == waiting:
            break
        waiting = left
    tree = settled_tops(parts)
    indent = F.repeat(F.lit("  "), F.col("level") - 1)
    return tree.select(
        F.concat(indent, "waiter").alias("lock_tree"), "waiter", "level", F.col("top").alias("root"),
        F.array_join("path", "/").alias("path"),
    )


def settled_tops(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows whose root is known."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def blocked_by(
    locks: DataFrame, resource: Sequence[str], session: str | Sequence[str], holds: str, waits: str, order: Sequence[str]
) -> DataFrame:
    """Every waiting session with the session that blocks it and how many sessions do.

    A resource with many holders and many waiters has holders times waiters pairs. This keeps one row per
    waiter: the first holder by ``order`` other than the waiter itself, and the number of such holders;
    ``contended_locks`` lists the holders themselves. Missing parts of the resource identity match each other.
    A ``session`` of several columns, such as instance and id, gives a ``waiter_`` and a ``blocker_`` column for each.
    """
    parts = [session] if isinstance(session, str) else list(session)
    measures = [c for c in order if c not in parts]
    holding, waiting = F.coalesce(F.expr(holds), F.lit(False)), F.coalesce(F.expr(waits), F.lit(False))
    rows = locks.select(
        *resource, *[F.col(c).alias(f"_s_{c}") for c in parts], holding.alias("_h"), waiting.alias("_w"),
        *[F.when(holding, F.col(c)).alias(f"_m_{c}") for c in measures],
    ).filter("_h OR _w")
    who = [f"_s_{c}" for c in parts]
    # Grouping takes two nulls for equal, so the columns themselves are the key.
    sessions = rows.groupBy(*resource, *who).agg(
        F.max("_h").alias("_h"), F.max("_w").alias("_w"), *[F.max(f"_m_{c}").alias(f"_m_{c}") for c in measures]
    )
    best_first = [F.col(f"_m_{c}").desc() for c in measures] + [F.col(c) for c in who]
    holders = sessions.filter("_h").select(*resource, *who, *[f"_m_{c}" for c in measures])
    leading = top_n_per_group(holders, list(resource), best_first, 2, "_place")
    at = lambda place, c: F.max(F.when(F.col("_place") == place, F.col(f"_s_{c}")))
    leading = leading.groupBy(*resource).agg(
        *[at(1, c).alias(f"_first_{c}") for c in parts], *[at(2, c).alias(f"_second_{c}") for c in parts], F.max("_place").alias("_named")
    )
    counts = holders.groupBy(*resource).agg(F.count("*").alias("_holders"))
    known = lookup_join(leading, counts, list(resource), "inner", null_safe=True)
    found = lookup_join(sessions.filter("_w"), known, list(resource), "inner", null_safe=True)
    itself = F.lit(True)
    for c in parts:
        itself = itself & F.col(f"_first_{c}").eqNullSafe(F.col(f"_s_{c}"))
    found = found.filter(~itself | (F.col("_named") > 1))
    several = len(parts) > 1
    return found.select(
        *resource, *[F.col(f"_s_{c}").alias(f"waiter_{c}" if several else "waiter") for c in parts],
        *[
            F.when(itself, F.col(f"_second_{c}")).otherwise(F.col(f"_first_{c}")).alias(f"blocker_{c}" if several else "blocker")
            for c in parts
        ],
        (F.col("_holders") - F.col("_h").cast("int")).alias("n_blockers"),
    )


def contended_locks(
    locks: DataFrame, resource: Sequence[str], session: str, holds: str, waits: str
) -> DataFrame:
    """Every holder and every waiter of each resource that has both, with the number of each."""
    roles = locks.select(
        *resource, session, F.expr(f"CASE WHEN {holds} THEN 'holder' WHEN {waits} THEN 'waiter' END").alias("role")
    ).filter("role IS NOT NULL").distinct()
    sums = roles.groupBy(*resource).agg(
        F.count_if(F.col("role") == "holder").alias("holders"), F.count_if(F.col("role") == "waiter").alias("waiters")
    )
    return lookup_join(roles, sums.filter("holders > 0 AND waiters > 0"), list(resource), "inner")


def wait_chains(df: DataFrame, n: int = 100) -> DataFrame:
    """The first ``n`` sessions that block others or have waited over ten seconds for another."""
    kept = df.filter(
        (F.col("num_waiters") > 0) | (F.col("blocker").isNotNull() & (F.col("in_wait_secs") > 10))
    )
    return top_n(kept, [F.col("chain_id"), F.col("num_waiters").desc(), F.col("waiter")], n)
