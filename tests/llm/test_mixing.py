import collections
import random
import statistics

import pytest

from tidemark.llm.mixing import MOST, SHARE, WEIGHTS, chance, copies_to_target, mixed_corpus, mixing_digest, transfer


def brute_targets(sizes):
    """Targets by sharing the excess again and again, source by source."""
    order = sorted(sizes, key=lambda s: (s is None, s if s is None else s.encode()))
    weight = {s: WEIGHTS[k % 3] for k, s in enumerate(order)}
    left, open_, target = SHARE * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] > MOST * sizes[s]}
        if not above:
            return target | {s: level * weight[s] for s in open_}
        for s in above:
            target[s] = MOST * sizes[s]
            left -= target[s]
        open_ -= above
    return target


def rows_of(seed, n=3000):
    draw = random.Random(seed)
    names = ["b", "a", "Z", "é", "", "😀", None]
    rows = [(k, " ".join(["w"] * draw.choice([0, 1, 3, 9, 40, 200])), names[min(draw.randrange(14), 6)]) for k in range(n)]
    return rows + [(n, "long " * 5000, "a"), (n + 1, None, "a"), (n + 2, "only words here", "alone"), (None, "no id", "b"), (7, "twice", "b"), (7, "twice", "b")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_targets_sums_and_limits(spark):
    rows = rows_of(1)
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    wanted = brute_targets(sizes)
    got = mixing_digest(frame(spark, rows)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(k) for k, _, _ in rows)
    source_of = {k: s for k, _, s in rows if k is not None}
    for r in got:
        if r["doc_id"] == 7:
            continue
        source = "b" if r["doc_id"] is None else source_of[r["doc_id"]]
        assert r["source_size"] == sizes[source] and r["target"] == pytest.approx(wanted[source])
        share = wanted[source] / sizes[source] if sizes[source] else 0
        assert r["taken"] in {int(share) * r["size"], (int(share) + (share > int(share))) * r["size"]} and r["taken"] <= 2 * r["size"]
    words = {(r["source_size"], r["target"]): 0 for r in got}
    for r in got:
        words[r["source_size"], r["target"]] += r["taken"]
    # What is left at the end of a source is one of its small documents, where it has some.
    assert all(abs(total - target) <= 200 for (size, target), total in words.items())


@pytest.mark.parametrize("leaf", [4, 64, 100_000])
def test_tree_keeps_sums(spark, leaf):
    """Groups of any size give the same sums, and partitions do not change who is drawn."""
    df = frame(spark, [(k, "x", "s") for k in range(1501)] + [(k, "y", None) for k in range(500)]).selectExpr("doc_id", "source", "1 + doc_id % 5 as size")
    got = copies_to_target(df, leaf=leaf, fan=3)
    first = sorted(map(str, got.collect()))
    again = copies_to_target(df.repartition(5, "size"), leaf=leaf, fan=3)
    assert sorted(map(str, again.collect())) == first
    sums = got.groupBy("source").agg({"target": "max"}).collect()
    taken = {r[0]: r[1] for r in got.selectExpr("source", "copies * size as t").groupBy("source").sum("t").collect()}
    assert all(abs(taken[s] - t) <= 5 for s, t in sums)
    assert sorted(map(str, copies_to_target(df, leaf=leaf, fan=3, seed=1).collect())) != first


def test_transfer_keeps_words_and_means():
    draw = random.Random(2)
    for _ in range(300):
        a, b, p, q = draw.randint(1, 50), draw.randint(1, 50), draw.uniform(0.01, 0.99), draw.uniform(0.01, 0.99)
        for u in (0.0, 0.5, 0.999):
            x, y = transfer(a, p, b, q, u)
            assert a * x + b * y == pytest.approx(a * p + b * q) and 0 <= x <= 1 and 0 <= y <= 1 and {x, y} & {0.0, 1.0}
    many = [transfer(10, 0.3, 4, 0.6, chance(k, 5, 1)) for k in range(20_000)]
    assert statistics.mean(x for x, _ in many) == pytest.approx(0.3, abs=0.01)
    assert statistics.mean(y for _, y in many) == pytest.approx(0.6, abs=0.01)


def test_each_row_is_drawn_as_often_as_it_should(spark):
    """Rows of every size class are taken as often as the source's share says, over many rows."""
    df = spark.createDataFrame([(k, "s" if k < 8000 else "t", 1 + k % 7) for k in range(12_000)], "doc_id long, source string, size long")
    got = copies_to_target(df, leaf=64, fan=16).groupBy("source", "size").agg({"copies": "avg", "target": "max", "source_size": "max"}).collect()
    assert all(r["avg(copies)"] == pytest.approx(r["max(target)"] / r["max(source_size)"], abs=0.08) for r in got) and len(got) == 14


def test_corpus_and_odd_rows(spark, documents):
    df = documents([(k, "some text " * k) for k in range(20)] + [(None, None), (3, "")]).withColumnRenamed("lang", "target").withColumnRenamed("n_chars", "_order")
    got = mixed_corpus(df)
    assert got.columns == df.columns
    texts = {r["text"] for r in df.collect()}
    rows = got.collect()
    assert {r["text"] for r in rows} <= texts and {r["target"] for r in rows} == {"en"}
    words = sum(len((r["text"] or "").split()) for r in rows)
    assert abs(words - 1.5 * 2 * sum(range(20))) <= 38
    assert mixed_corpus(df.where("false")).count() == 0 and mixing_digest(df.where("false")).count() == 0
    nothing = mixing_digest(documents([(1, None), (2, " ")])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in nothing] == [(0, 0.0, 0)] * 2
