import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import waits
from tidemark.operators.waits import wait_cycles, wait_tree
from tidemark.session import written

PLANTED = [
    [("a", "b"), ("b", "a"), ("c", "a"), ("x", "y"), ("z", "y")],
    [("a", "a")],
    [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")],
    [("r", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("s", "d"), ("d", "d")],
    [(f"n{k:04}", f"n{k + 1:04}") for k in range(100)],
    [(f"n{k:04}", f"n{(k + 1) % 70:04}") for k in range(70)] + [("n0005", "t1"), ("t1", "t2")],
    [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("a", "e")],
    [],
]


def drawn(seed):
    draw = random.Random(seed)
    n = draw.choice([3, 6, 12, 30])
    return [(f"v{draw.randrange(n)}", f"v{draw.randrange(n)}") for _ in range(draw.randint(1, 2 * n))]


def reach(edges):
    """Everybody that a waiter waits for, over others."""
    up = {}
    for blocker, waiter in edges:
        up.setdefault(waiter, set()).add(blocker)
    found = {}
    for start in up:
        seen, todo = set(), list(up[start])
        while todo:
            v = todo.pop()
            if v not in seen:
                seen.add(v)
                todo += up.get(v, ())
        found[start] = seen
    return up, found


#: All graphs side by side in one: names of each begin with its number.
EDGES = [(f"{g:02}{b}", f"{g:02}{w}") for g, edges in enumerate([*PLANTED, *[drawn(s) for s in range(30)]]) for b, w in edges]


def test_cycles_equal_brute_force(spark):
    edges = EDGES
    _, found = reach(edges)
    groups = {v: frozenset({u for u in seen if v in found.get(u, ())}) for v, seen in found.items() if v in seen}
    want = {(min(g), v, len(g)) for v, g in groups.items()}
    got = wait_cycles(spark.createDataFrame([*edges, *edges[:2], (None, "q"), ("q", None)], "blocker string, waiter string"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_tree_loses_no_wait(spark):
    edges = EDGES
    up, found = reach(edges)
    roots = {b for b, _ in edges} - set(up)
    rows = wait_tree(spark.createDataFrame([*edges, *edges[:1]], "blocker string, waiter string")).collect()
    assert sorted((r.blocker, r.waiter) for r in rows if r.kind != "root") == sorted(set(edges))
    assert {r.waiter for r in rows if r.kind == "root"} == roots
    main = {}
    for r in rows:
        leads = r.blocker in roots or bool(found.get(r.blocker, set()) & roots)
        assert r.kind == "root" or (r.kind != "circle") == leads
        assert r.n_blockers == len(up.get(r.waiter, ()))
        if r.kind in ("root", "wait"):
            assert r.waiter not in main
            main[r.waiter] = r
    for r in rows:
        if r.kind in ("wait", "again"):
            above = main[r.blocker]
            assert (r.root, r.level, r.path) == (above.root, above.level + 1, f"{above.path}/{r.waiter}")
            assert r.lock_tree == "  " * (r.level - 1) + r.waiter
    assert set(main) == roots | {v for v, seen in found.items() if seen & roots}
    # The place is below the least of the blockers that lead to a root past the fewest branching waiters.
    past = {v: 0 for v in roots}
    changed = True
    while changed:
        changed = False
        for waiter, blockers in up.items():
            best = min((past[b] for b in blockers if b in past), default=None)
            if best is not None and past.get(waiter, 10**9) > best + (len(blockers) > 1):
                past[waiter], changed = best + (len(blockers) > 1), True
    for v, r in main.items():
        if r.kind == "wait":
            assert r.blocker == min(b for b in up[v] if b in past and past[b] == min(past[c] for c in up[v] if c in past))


def test_no_edges(spark):
    none = spark.createDataFrame([], "blocker string, waiter string")
    assert wait_cycles(none).count() == 0 and wait_tree(none).count() == 0


@pytest.fixture
def frames(monkeypatch):
    """All that the operators write on the way, with its purpose."""
    kept = []

    def keep(df, purpose):
        kept.append((purpose, written(df, purpose)))
        return kept[-1][1]

    monkeypatch.setattr(waits, "written", keep)
    return kept


#: Many circles of two, and a tail that leads into a circle of three with later names than the tail has.
CIRCLING = [e for k in range(80) for e in ((f"p{k:02}", f"q{k:02}"), (f"q{k:02}", f"p{k:02}"))]
TAIL = [(f"t{k:02}", f"t{k + 1:02}") for k in range(5)] + [("x", "t00"), ("y", "x"), ("z", "y"), ("x", "z")]


def test_circles_are_found_without_paths(spark, frames):
    got = wait_cycles(spark.createDataFrame([*CIRCLING, *TAIL], "blocker string, waiter string"))
    want = [(f"p{k:02}", f"{v}{k:02}", 2) for k in range(80) for v in "pq"] + [("x", v, 3) for v in "xyz"]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert not [c for _, df in frames for c, kind in df.dtypes if kind.startswith("array")]
    # As many rounds as the logarithm of the longest chain and circle, not of the number of rows that go round.
    purposes = [purpose for purpose, _ in frames]
    assert purposes.count("chains") <= 3 and purposes.count("circles") <= 6


def test_paths_are_as_long_as_the_tree_is_deep(spark, frames):
    chain = [("r", "a"), ("a", "b"), ("b", "c"), ("r", "d"), ("c", "d"), ("d", "e")]
    rows = wait_tree(spark.createDataFrame([*CIRCLING, *TAIL, *chain], "blocker string, waiter string")).collect()
    want = {
        ("root", None, "r", "r"), ("wait", "r", "a", "r/a"), ("wait", "a", "b", "r/a/b"), ("wait", "b", "c", "r/a/b/c"),
        ("wait", "c", "d", "r/a/b/c/d"), ("again", "r", "d", "r/d"), ("wait", "d", "e", "r/a/b/c/d/e"),
    }
    assert {(r.kind, r.blocker, r.waiter, r.path) for r in rows if r.kind != "circle"} == want
    assert sorted((r.blocker, r.waiter) for r in rows if r.kind == "circle") == sorted([*CIRCLING, *TAIL])
    paths = [df.agg(F.max(F.size(c))).first()[0] for _, df in frames for c, kind in df.dtypes if kind.startswith("array")]
    assert max(p or 0 for p in paths) <= 5
