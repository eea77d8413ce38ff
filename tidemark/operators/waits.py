"""Whole wait graphs: waiters with several blockers, and circles of sessions that wait for each other.

A waiter with one blocker is a link of a chain. Chains are shortened by pointer doubling to their ends, so that only the
branching waiters, those with several blockers, are left for steps that follow the graph edge by edge.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.skew import lookup_join
from tidemark.session import written


def _edges(edges: DataFrame) -> DataFrame:
    """Distinct waits; a row without a blocker or a waiter is none."""
    return written(edges.select("blocker", "waiter").filter("blocker IS NOT NULL AND waiter IS NOT NULL").distinct(), "waits")


def _ends(links: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(settled, strides) of ``links`` (waiter, top), one row each waiter: ``settled`` has the end of every chain as its ``top``.

    Each round puts an ancestor's ancestor in the place of the ancestor, so there are as many rounds as the logarithm of the
    longest chain. ``strides`` has the rows that are open before each round and at the end: the ancestor that is twice as far
    every time, where the chain goes that far. The open row next to an end ends in the next round, so those that are left
    after a round without ends go round in a circle; they are the last of ``strides``. A ``path`` of the links is put together
    from the top down, so links that have one must not lead into circles.
    """
    path = [c for c in ("path",) if c in links.columns]
    single = links.select(F.col("waiter").alias("top"), F.lit(1).alias("open"))
    rows = written(lookup_join(links, single, ["top"]), "chains")
    done, strides = [rows.filter("open IS NULL").drop("open")], [rows.filter("open = 1").drop("open")]
    left, before = strides[0].count(), None
    while left and left != before:
        known = reduce(DataFrame.unionByName, done).withColumn("ended", F.lit(True)).unionByName(strides[-1].withColumn("ended", F.lit(False)))
        jumps = known.select(F.col("waiter").alias("top"), F.col("top").alias("_next"), *[F.col(c).alias("_path") for c in path], "ended")
        # Files of paths are a small part of what they hold, too small a part to choose a broadcast by.
        jumps = jumps.hint("merge") if path else jumps
        moved = written(
            lookup_join(strides[-1], jumps, ["top"], "inner").select(
                "waiter", F.col("_next").alias("top"), *[F.concat("_path", c).alias(c) for c in path], "ended"
            ), "chains",
        )
        done.append(moved.filter("ended").drop("ended"))
        strides.append(moved.filter("NOT ended").drop("ended"))
        left, before = strides[-1].count(), left
    return written(reduce(DataFrame.unionByName, done), "chains"), strides


def _chains(edges: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(waiters, settled, strides): every waiter with its number of blockers and the least of them, and the :func:`_ends` of
    the waiters with one blocker: each with the root or branching waiter (``top``) that its chain ends at."""
    waiters = written(edges.groupBy("waiter").agg(F.count("*").alias("n_blockers"), F.min("blocker").alias("blocker")), "waiters")
    return waiters, *_ends(waiters.filter("n_blockers = 1").select("waiter", F.col("blocker").alias("top")))


def _links(edges: DataFrame, waiters: DataFrame, settled: DataFrame) -> DataFrame:
    """(waiter, blocker, top) for every wait of a branching waiter: the end of the blocker's chain.

    A blocker that is a root or a branching waiter is its own end; one that waits in a circle has none.
    """
    branching = waiters.filter("n_blockers > 1").select("waiter")
    own = edges.join(branching, "waiter", "left_semi")
    known = waiters.select(F.col("waiter").alias("blocker"), F.col("n_blockers").alias("_n"))
    chain = settled.select(F.col("waiter").alias("blocker"), F.col("top").alias("_top"))
    joined = lookup_join(lookup_join(own, known, ["blocker"]), chain, ["blocker"])
    itself = F.col("_n").isNull() | (F.col("_n") > 1)
    return written(joined.select("waiter", "blocker", F.when(itself, F.col("blocker")).otherwise(F.col("_top")).alias("top")), "links")


def wait_tree(edges: DataFrame) -> DataFrame:
    """One row per root and per wait: (kind, blocker, waiter, level, root, path, n_blockers, lock_tree).

    ``edges`` are ``(blocker, waiter)`` texts. A waiter's place in the tree is below one of its blockers: of those that lead
    to a root past the fewest branching waiters, the least. That row has kind ``wait`` and the waiter's own waiters below
    it; its other waits have kind ``again`` below their blockers, or ``circle``, without a level and a path, where a blocker
    leads to no root. Roots, which wait for nobody, have kind ``root``. Repeated edges count once, rows with a null are left
    out, so the rows are the roots and the distinct waits, and none is lost. Sort by ``path`` for the listing. Paths are made
    last, of those that have a place, and are as long as the tree is deep.
    """
    edges = _edges(edges)
    waiters, settled, _ = _chains(edges)
    links = _links(edges, waiters, settled)
    blockers = edges.select(F.col("blocker").alias("waiter")).distinct()
    roots = written(blockers.join(waiters, "waiter", "left_anti"), "roots")
    known = [roots.select(F.col("waiter").alias("top"), F.lit(None).cast("string").alias("under"))]
    fresh, open_links = known[0], links.filter("top IS NOT NULL")
    while True:
        reached = lookup_join(open_links, fresh.select("top"), ["top"], "inner")
        fresh = written(reached.groupBy(F.col("waiter").alias("top")).agg(F.min("blocker").alias("under")), "tops")
        if fresh.isEmpty():
            break
        known.append(fresh)
        open_links = written(open_links.join(fresh.select(F.col("top").alias("waiter")), "waiter", "left_anti"), "links")
    tops = reduce(DataFrame.unionByName, known)
    chained = lookup_join(settled, tops.select("top"), ["top"], "inner").select("waiter")
    main = lookup_join(chained, waiters.select("waiter", F.col("blocker").alias("top")), ["waiter"], "inner").unionByName(
        tops.filter("under IS NOT NULL").select(F.col("top").alias("waiter"), F.col("under").alias("top"))
    )
    main = written(main, "main")
    below, _ = _ends(main.withColumn("path", F.array("waiter")))
    places = below.select("waiter", F.col("top").alias("root"), F.concat(F.array("top"), "path").alias("whole")).unionByName(
        roots.select("waiter", F.col("waiter").alias("root"), F.array("waiter").alias("whole"))
    )
    own = main.select("waiter", F.col("top").alias("_main"))
    above = places.select(F.col("waiter").alias("blocker"), "root", F.col("whole").alias("_above"))
    waits = lookup_join(lookup_join(edges, waiters.select("waiter", "n_blockers"), ["waiter"]), own, ["waiter"])
    waits = lookup_join(waits, above.hint("merge"), ["blocker"])
    kind = F.when(F.col("_above").isNull(), "circle").when(F.col("blocker") == F.col("_main"), "wait").otherwise("again")
    rows = waits.select(
        kind.alias("kind"), "blocker", "waiter", "root", F.concat("_above", F.array("waiter")).alias("whole"), F.col("n_blockers")
    ).unionByName(roots.select(
        F.lit("root").alias("kind"), F.lit(None).cast("string").alias("blocker"), "waiter", F.col("waiter").alias("root"),
        F.array("waiter").alias("whole"), F.lit(0).cast("bigint").alias("n_blockers"),
    ))
    level = F.when(F.col("whole").isNotNull(), F.size("whole"))
    return rows.select(
        "kind", "blocker", "waiter", level.alias("level"), "root", F.array_join("whole", "/").alias("path"), "n_blockers",
        F.concat(F.repeat(F.lit("  "), F.coalesce(level, F.lit(1)) - 1), "waiter").alias("lock_tree"),
    )


def _circles(edges: DataFrame, circling: DataFrame) -> DataFrame:
    """(waiter, circle) of the circles that consist of waiters with one blocker; ``circle`` is the least of its waiters.

    Steps double. What is arrived at gets less until it is the circles alone, and then no more; a least one that nobody lowers
    in a round is lowered in no later one.
    """
    rows = written(edges.join(circling, "waiter", "left_semi").select("waiter", F.col("blocker").alias("to"), F.least("blocker", "waiter").alias("least")), "circles")
    arrived = rows.select("to").distinct().count()
    moving = arrived > 0
    while moving:
        ahead = rows.select(F.col("waiter").alias("to"), F.col("to").alias("_to"), F.col("least").alias("_least"))
        moved = written(
            lookup_join(rows, ahead, ["to"], "inner").select("waiter", F.col("_to").alias("to"), F.least("least", "_least").alias("_now"), "least"), "circles"
        )
        rows = moved.select("waiter", "to", F.col("_now").alias("least"))
        arrived, before = rows.select("to").distinct().count(), arrived
        moving = arrived < before or not moved.filter("_now < least").isEmpty()
    on = rows.select(F.col("to").alias("waiter")).distinct()
    return rows.join(on, "waiter", "left_semi").select("waiter", F.col("least").alias("circle"))


def _least_reached(edges: DataFrame) -> DataFrame:
    """(waiter, least): the least of everybody that a waiter of ``edges`` (waiter, top) leads to, itself included.

    What is known of the least one so far is passed on as well, so that the way to it is cut short every round.
    """
    ends = edges.select("waiter").unionByName(edges.select(F.col("top").alias("waiter"))).distinct()
    known = written(ends.withColumn("least", F.col("waiter")), "least")
    while True:
        ahead = known.select(F.col("waiter").alias("top"), F.col("least").alias("_ahead"))
        offered = lookup_join(edges, ahead, ["top"], "inner").groupBy("waiter").agg(F.min("_ahead").alias("_offered"))
        beyond = known.select(F.col("waiter").alias("least"), F.col("least").alias("_beyond"))
        both = lookup_join(known.join(offered, "waiter", "left"), beyond, ["least"])
        moved = written(both.select("waiter", F.least("least", "_offered", "_beyond").alias("_now"), "least"), "least")
        known = moved.select("waiter", F.col("_now").alias("least"))
        if moved.filter("_now < least").isEmpty():
            return known


def _components(edges: DataFrame) -> DataFrame:
    """(waiter, circle): the branching waiters that wait for each other; ``edges`` are (waiter, top).

    Those of a circle lead to the same least waiter, so only waits between waiters that do are kept, and then only those
    between waiters that the same least one leads to. Waiters that lead to and are led to from the same one are its
    circle; without them the rest begins again. All steps take as many rows as there are edges.
    """
    found = []
    while not edges.isEmpty():
        ahead = _least_reached(edges)
        inside = written(_within(edges, ahead), "inside")
        behind = _least_reached(inside.select(F.col("top").alias("waiter"), F.col("waiter").alias("top")))
        inside = written(_within(inside, behind), "inside")
        whole = ahead.join(behind.withColumnRenamed("least", "_behind"), "waiter").filter("least = _behind").select("waiter", F.col("least").alias("circle"))
        whole = written(whole, "whole")
        # One waiter alone is a circle only if it waits for itself.
        found.append(written(whole.join(inside.select("waiter").distinct(), "waiter", "left_semi"), "component"))
        edges = written(inside.join(whole, "waiter", "left_anti"), "rest")
    return reduce(DataFrame.unionByName, found) if found else edges.select("waiter", F.col("waiter").alias("circle"))


def _within(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges whose ends have the same label."""
    own, other = labels.withColumnRenamed("least", "_own"), labels.select(F.col("waiter").alias("top"), F.col("least").alias("_other"))
    return lookup_join(lookup_join(edges, own, ["waiter"], "inner"), other, ["top"], "inner").filter("_own = _other").select("waiter", "top")


def wait_cycles(edges: DataFrame) -> DataFrame:
    """(circle, waiter, n_waiters): sessions that wait for each other, however many blockers they have.

    Two sessions are in one circle if each waits, over others, for the other one; a session that waits for itself is one,
    too. ``circle`` is the least session of it. Nobody who merely waits for a circle is listed. Repeated edges count once and
    rows with a null are left out; a graph without circles has no rows.
    """
    edges = _edges(edges)
    waiters, settled, strides = _chains(edges)
    links = _links(edges, waiters, settled).filter("top IS NOT NULL")
    branching = waiters.filter("n_blockers > 1").select(F.col("waiter").alias("top"))
    between = written(links.join(branching, "top", "left_semi"), "between")
    groups = _components(between.select("waiter", "top").distinct())
    ends = groups.select(F.col("waiter").alias("top"), F.col("circle").alias("_end"))
    inside = lookup_join(lookup_join(between, groups, ["waiter"], "inner"), ends, ["top"], "inner").filter("circle = _end")
    inside = written(inside, "inside")
    # The chains between two branching waiters of a circle are part of it.
    chained = written(inside.filter("blocker <> top").select("circle", F.col("blocker").alias("waiter")).distinct(), "chained")
    for stride in strides[:-1]:
        ahead = lookup_join(chained, stride, ["waiter"], "inner").select("circle", F.col("top").alias("waiter"))
        chained = written(chained.unionByName(ahead).distinct(), "chained")
    parts = inside.select("circle", "waiter").unionByName(chained)
    members = parts.unionByName(_circles(edges, strides[-1].select("waiter")).select("circle", "waiter")).distinct()
    named = members.groupBy("circle").agg(F.min("waiter").alias("_least"), F.count("*").alias("n_waiters"))
    return lookup_join(members, named, ["circle"], "inner").select(F.col("_least").alias("circle"), "waiter", "n_waiters")
