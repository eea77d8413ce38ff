import random

import numpy as np
import pytest

from tidemark.llm.jaccard import components, near_duplicates, one_of_each, similar

LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    import re

    words = re.findall("[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def brute(rows):
    """Component of each id by comparing all pairs."""
    sets = [(k, shingles(t)) for k, t in rows if k is not None]
    up = {k: k for k, _ in sets}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, (x, s) in enumerate(sets):
        for y, t in sets[:a]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                lo, hi = sorted((root(x), root(y)))
                up[hi] = lo
    return {k: root(k) for k in up}


def family(draw, base, n, changes):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(changes):
            words[draw.randrange(len(words))] = f"w{draw.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def rows_of(seed):
    draw = random.Random(seed)
    texts = []
    for size, changes, length in ((60, 1, 90), (50, 2, 130), (25, 3, 400), (10, 0, 40)):
        texts += family(draw, [f"v{draw.randrange(10**6)}" for _ in range(length)], size, changes)
    common = " ".join(f"c{k}" for k in range(60))
    texts += [common + " " + " ".join(f"u{draw.randrange(10**6)}" for _ in range(draw.choice([5, 8, 30, 200]))) for _ in range(40)]
    texts += ["a b c", "A  b\tc", "a b c d e", "", "   ", "x", "x", "a b c d e f", "the " * 500, "the " * 700, "é 中文 ſ K", "é 中文 ſ K"]
    ids = draw.sample(range(10**6), len(texts))
    return list(zip(ids, texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(documents, seed):
    rows = rows_of(seed) + [(7_000_001, None)]
    want = brute(rows)
    got = {r["doc_id"]: r for r in near_duplicates(documents(rows)).collect()}
    assert {k: r["component_id"] for k, r in got.items()} == want
    assert {k: r["n_shingles"] for k, r in got.items()} == {k: len(shingles(t)) for k, t in rows}


def test_borders_of_similarity():
    for n in range(1, 60):
        for shared in range(n + 1):
            one = np.arange(n, dtype=np.uint64)
            other = np.concatenate([one[:shared], np.arange(1000, 1000 + n - shared, dtype=np.uint64)])
            assert similar(one, other, 80) == (100 * shared >= 80 * (2 * n - shared))


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(500, 499), (499, 498), (5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, **{100 + k: 100 for k in range(30)}, 498: 498, 499: 498, 500: 498}


def test_rows(spark, documents):
    rows = [(3, "a b c d e f g"), (1, "A b c d e f g"), (None, "a b c d e f g"), (None, None), (2, None), (4, ""), (9, "p q r s t u"), (9, "p q r s t u"), (8, "p q r s t u")]
    df = documents(rows).withColumnRenamed("lang", "component_id").withColumnRenamed("source", "members")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(3, 3, 1), (1, 3, 1), (None, 3, None), (None, 0, None), (2, 0, 2), (4, 0, 4), (9, 2, 8), (9, 2, 8), (8, 2, 8)], key=str)
    kept = one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, None, None, 2, 4, 8], key=str)
    twice = one_of_each(documents([(1, "k l m n o"), (1, "k l m n o"), (2, "x y")]))
    assert sorted(r["doc_id"] for r in twice.collect()) == [1, 2]
    assert near_duplicates(df.where("false")).count() == 0 and one_of_each(df.where("false")).count() == 0
