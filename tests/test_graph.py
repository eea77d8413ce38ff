import random

from tidemark.operators import graph


def tree(spark, pairs):
    rows = graph.blocking_tree(spark.createDataFrame(pairs, "blocker string, waiter string")).collect()
    return {r.waiter: (r.level, r.root, r.path) for r in rows}


def test_small_tree(spark):
    got = tree(spark, [("a", "b"), ("b", "c"), ("a", "d"), ("x", "y")])
    assert got == {
        "a": (1, "a", "a"), "b": (2, "a", "a/b"), "c": (3, "a", "a/b/c"), "d": (2, "a", "a/d"), "x": (1, "x", "x"), "y": (2, "x", "x/y"),
    }


def test_listing_is_depth_first(spark):
    rows = graph.blocking_tree(spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d")], "blocker string, waiter string"))
    assert [r.lock_tree for r in rows.orderBy("path").collect()] == ["a", "  b", "    c", "  d"]


def test_circles_are_left_out(spark):
    got = tree(spark, [("a", "b"), ("p", "q"), ("q", "r"), ("r", "p"), ("q", "s")])
    assert set(got) == {"a", "b"}


def test_random_forest_against_walk(spark):
    draw = random.Random(5)
    parent = {n: draw.randrange(n) for n in range(1, 120) if draw.random() < 0.9}
    parent.update({n: n - 1 for n in range(200, 240)})
    got = tree(spark, [(str(p), str(n)) for n, p in parent.items()])

    def path(n):
        return path(parent[n]) + [n] if n in parent else [n]

    nodes = set(parent) | set(parent.values())
    assert set(got) == {str(n) for n in nodes}
    for n in nodes:
        assert got[str(n)] == (len(path(n)), str(path(n)[0]), "/".join(map(str, path(n))))


def test_blocked_by_against_pairs(spark):
    draw = random.Random(7)
    locks = [
        (draw.choice([1, 2, None]), draw.choice(["x", "y", "z"]), draw.randrange(6), draw.random() < 0.4, draw.randrange(50))
        for _ in range(60)
    ]
    df = spark.createDataFrame(locks, "r int, q string, s int, held boolean, age int")
    rows = graph.blocked_by(df, ["r", "q"], "s", "held", "NOT held", ["age", "s"]).collect()
    got = {(r.r, r.q, r.waiter): (r.blocker, r.n_blockers) for r in rows}
    want = {}
    for r, q, s, held, _ in locks:
        if held:
            continue
        ages = {}
        for r2, q2, s2, held2, age2 in locks:
            if held2 and (r2, q2) == (r, q) and s2 != s:
                ages[s2] = max(ages.get(s2, -1), age2)
        if ages:
            want[(r, q, s)] = (min(ages, key=lambda k: (-ages[k], k)), len(ages))
    assert got == want


def test_contended_locks_count_both_sides(spark):
    df = spark.createDataFrame([(1, 10, True), (1, 11, False), (1, 12, False), (2, 13, False), (3, 14, True)], "r int, s int, held boolean")
    rows = graph.contended_locks(df, ["r"], "s", "held", "NOT held").collect()
    assert {(r.r, r.s, r.role) for r in rows} == {(1, 10, "holder"), (1, 11, "waiter"), (1, 12, "waiter")}
    assert {(r.holders, r.waiters) for r in rows} == {(1, 2)}


def test_one_session_id_on_several_instances(spark):
    rows = [(1, 10, True, 9), (2, 10, False, 0), (1, 11, False, 0), (1, 10, False, 0)]
    df = spark.createDataFrame([("t", *r) for r in rows], "r string, inst int, sid int, held boolean, age int")
    found = graph.blocked_by(df, ["r"], ["inst", "sid"], "held", "NOT held", ["age", "inst", "sid"]).collect()
    got = {(x.waiter_inst, x.waiter_sid): (x.blocker_inst, x.blocker_sid, x.n_blockers) for x in found}
    assert got == {(2, 10): (1, 10, 1), (1, 11): (1, 10, 1)}


def test_resources_of_odd_texts_stay_apart(spark):
    rows = [("a|=b", "c", 1, True), ("a", "b|=c", 2, False), (None, "c", 3, True), (None, "c", 4, False)]
    df = spark.createDataFrame(rows, "r string, q string, s int, held boolean")
    found = graph.blocked_by(df, ["r", "q"], "s", "held", "NOT held", ["s"]).collect()
    assert [(x.waiter, x.blocker) for x in found] == [(4, 3)]
