import collections
import random

import numpy as np

from tidemark.llm.passages import PrefixMaxima, _common, chains, covering, repeated_passages


def test_prefix_maxima():
    draw = random.Random(1)
    tree, plain = PrefixMaxima(40), {}
    for point in range(200):
        place, score = draw.randrange(40), draw.random()
        tree.put(place, score, point)
        plain[place] = max(plain.get(place, (float("-inf"), -1)), (score, point))
        at = draw.randrange(41)
        assert tree.before(at) == max([v for k, v in plain.items() if k < at], default=(float("-inf"), -1))


def test_chains_keep_order_and_break_at_gaps():
    assert chains([0, 5, 9, 12], [100, 105, 109, 112]) == [[0, 1, 2, 3]]
    assert chains([0, 5, 9, 300, 304], [0, 5, 9, 20, 24]) == [[0, 1, 2], [3, 4]]
    assert [0, 1, 3] in chains([0, 5, 7, 9], [10, 15, 3, 19])
    assert chains([0, 5], [9, 1]) == []


def test_common_equals_brute_force():
    draw = random.Random(2)
    for _ in range(200):
        a = [draw.randrange(4) for _ in range(draw.randint(0, 9))]
        b = [draw.randrange(4) for _ in range(draw.randint(0, 9))]
        best = collections.defaultdict(int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i, j] = max(best[i - 1, j], best[i, j - 1], best[i - 1, j - 1] + (x == y))
        assert _common(np.array(a), np.array(b)) == (best[len(a) - 1, len(b) - 1] if a and b else 0)


def test_covering_keeps_every_word():
    draw = random.Random(3)
    for _ in range(300):
        passages = [(a, a + draw.randint(1, 12)) for a in (draw.randrange(40) for _ in range(draw.randint(0, 12)))]
        words = lambda some: {w for a, b in some for w in range(a, b)}
        kept = covering(passages)
        assert words(kept) == words(passages) and set(kept) <= set(passages)
    assert len(covering([(a, a + 70) for a in range(500)])) <= 9


def planted(seed):
    draw = random.Random(seed)
    fresh = lambda n: [f"w{draw.randrange(10**7)}" for _ in range(n)]
    shared, line = [fresh(n) for n in (51, 60, 90, 400)], fresh(20)
    rows, holders = [], collections.defaultdict(list)
    for k in range(120):
        words = fresh(draw.randint(5, 80))
        if k % 3 == 0:
            words += line
        if k % 2 == 0:
            p = draw.randrange(len(shared))
            body = list(shared[p])
            if k % 8 == 0:
                body[draw.randrange(10, 40)] = "changed"
            words += body
            holders[p].append(k)
        rows.append((k, " ".join(words + fresh(draw.randint(0, 80)))))
    return rows, shared, holders


def test_finds_planted_passages(documents):
    rows, shared, holders = planted(5)
    got = collections.defaultdict(list)
    for r in repeated_passages(documents(rows)).collect():
        got[r["doc_id"]].append(r)
    for p, docs in holders.items():
        for k in docs[1:]:
            assert any(r["first_doc_id"] == docs[0] and r["end_word"] - r["start_word"] >= len(shared[p]) - 1 for r in got[k]), (p, k)
    later = {k for docs in holders.values() for k in docs[1:]}
    assert set(got) == later


def test_finds_passages_with_many_changes(documents):
    draw = random.Random(7)
    fresh = lambda n: [f"w{draw.randrange(10**7)}" for _ in range(n)]
    rows, planted = [], {}
    for n in (55, 60, 120):
        for step in (6, 7, 8, 10):
            for _ in range(4):
                body, k, offset = fresh(n), len(rows), draw.randrange(step)
                copy = [f"c{draw.randrange(10**7)}" if at % step == offset else word for at, word in enumerate(body)]
                before, after = fresh(draw.randint(3, 30)), fresh(draw.randint(3, 30))
                rows += [(k, " ".join(fresh(9) + body + fresh(9))), (k + 1, " ".join(before + copy + after))]
                # Beyond the last five words in a row that are left nothing need be found.
                left = [at for at in range(n - 4) if all(copy[x] == body[x] for x in range(at, at + 5))]
                if left[-1] + 5 - left[0] >= 50:
                    planted[k + 1] = (len(before) + left[0], len(before) + left[-1] + 5)
    got = {r["doc_id"]: r for r in repeated_passages(documents(rows)).collect()}
    assert len(planted) == 40
    for k, (start, end) in planted.items():
        assert k in got and got[k]["first_doc_id"] == k - 1 and got[k]["start_word"] <= start and got[k]["end_word"] >= end, k


def test_finds_passages_whose_parts_stand_in_earlier_documents(documents):
    draw = random.Random(9)
    fresh = lambda n: [f"w{draw.randrange(10**7)}" for _ in range(n)]
    rows, full = [], []
    for cuts in ([(0, 35), (30, 60)], [(0, 25), (20, 45), (40, 70)], [(0, 30), (25, 50)]):
        body, first = fresh(cuts[-1][1]), len(rows)
        rows += [(first + k, " ".join(fresh(30) + body[a:b] + fresh(30))) for k, (a, b) in enumerate(cuts)]
        holders = [len(rows), len(rows) + 1, len(rows) + 2]
        rows += [(k, " ".join(fresh(20 + k) + body + fresh(20))) for k in holders]
        full += [(k, holders[0], 20 + k, 20 + k + len(body)) for k in holders[1:]]
    got = {(r["doc_id"], r["first_doc_id"], r["start_word"], r["end_word"]) for r in repeated_passages(documents(rows)).collect()}
    assert got == set(full)


def test_rows(spark, documents):
    body = " ".join(f"w{k}" for k in range(70))
    rows = [(4, body), (2, "before " + body.upper()), (None, body), (7, None), (8, ""), (9, "w1 w2 w3"), (2, "before " + body.upper()), (11, " ".join(f"x{k}" for k in range(30_000)))]
    df = documents(rows).withColumnRenamed("source", "words")
    got = [tuple(r) for r in repeated_passages(df).collect()]
    assert got == [(4, 2, 0, 70, 1, 71, 70)]
    assert repeated_passages(df.where("false")).count() == 0
