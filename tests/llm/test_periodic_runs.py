import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from tidemark.llm.periodic_runs import periodic_runs, planted, runs_digest, with_planted_runs, z_values


def brute_runs(words):
    """Stretches of equal words q apart, for each q, without those that have a smaller period."""
    found, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        at = 0
        while at + q < n:
            end = at
            while end + q < n and words[end] == words[end + q]:
                end += 1
            if end > at and end + q - at >= max(6, 4 * q) and (at, end + q - at) not in found:
                found[at, end + q - at] = q
            at = end + 1
    return sorted((start, length, q) for (start, length), q in found.items())


def brute(doc_id, text):
    words = (text or "").encode("utf-8", "surrogatepass").split()
    runs = brute_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    return (
        doc_id, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2],
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest(),
    )


def texts(seed, n):
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        words = []
        for _ in range(draw.randint(0, 5)):
            kind = draw.random()
            unit = [draw.choice("ab") if kind < 0.6 else f"w{draw.randrange(40)}" for _ in range(draw.choice([1, 2, 3, 5, 8, 13, 30]))]
            words += unit * draw.choice([1, 2, 3, 4, 5, 9]) + unit[: draw.randint(0, len(unit))]
            words += [f"x{draw.randrange(1000)}" for _ in range(draw.choice([0, 0, 1, 7, 40]))]
        out.append(draw.choice([" ", "\n", "\t ", " \x0b"]).join(words))
    return out


@pytest.mark.parametrize("tile_words", [1, 4, 37, 4096])
def test_equal_brute_force(documents, spark, tile_words):
    rows = list(enumerate(texts(tile_words, 250)))
    rows += [(1000, "a " * 700), (1001, "a b " * 300 + "c " + "a b " * 300), (1002, None), (1003, " "), (1004, "A a " * 9), (None, "é é é é é é"), (1001, "x x x x x x")]
    got = periodic_runs(documents(rows), tile_words=tile_words).collect()
    assert len(got) == len(rows)
    want = []
    for key, text in rows:
        words = (text or "").encode().split()
        runs = brute_runs(words)
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        want.append((str(key), len(words), runs, b" ".join(w for i, w in enumerate(words) if i not in dropped).decode()))
    assert sorted((str(r["doc_id"]), r["n"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got) == sorted(want)


def test_digest_equals_brute_force(documents):
    rows = list(enumerate(texts(77, 200)))
    rows += [(500, None), (501, ""), (None, "no id"), (502, "w " * 50_000)]
    got = runs_digest(documents(rows).withColumnRenamed("lang", "runs").withColumnRenamed("source", "row")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(brute(key, text)) if key != 502 else str(
        (502, 1, 0, 50_000, 1, 50_000_000, hashlib.sha256(b"0,50000,1\n").hexdigest(), hashlib.sha256(b"w").hexdigest())) for key, text in rows)
    assert runs_digest(documents([(1, "x")]).where("false")).count() == 0


def test_large_periods_over_many_tiles(documents):
    """Periods and runs longer than a tile, and one run that ends within another."""
    draw = random.Random(5)
    unit = [f"u{draw.randrange(10_000)}" for _ in range(700)]
    text = " ".join(["lead"] * 3 + unit * 5 + unit[:350] + ["tail"] * 9)
    row = periodic_runs(documents([(1, text)]), tile_words=16).first()
    assert [tuple(r) for r in row["runs"]] == [(3, 3850, 700), (3853, 9, 1)]
    assert row["collapsed"] == " ".join(["lead"] * 3 + unit + ["tail"])


def test_planted_runs(documents):
    draw = random.Random(6)
    rows = [(k, " ".join(f"w{draw.randrange(30)}" for _ in range(draw.randint(0, 300)))) for k in range(300)] + [(None, "a b"), (5000, None)]
    want = []
    for key, text in rows:
        words = (text or "").split()
        n, h = len(words), zlib.crc32(str(key).encode())
        if key is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        want.append(str(brute(key, " ".join(words))))
    got = runs_digest(with_planted_runs(documents(rows))).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(want)
    assert sum(r["n_runs"] > 0 for r in got) >= 10 and planted(None, [b"a"]) == [b"a"]


def test_z_values():
    draw = random.Random(8)
    for _ in range(200):
        words = [draw.randrange(2) for _ in range(draw.randint(1, 40))]
        most = draw.randint(1, 45)
        want = [next((k for k in range(len(words) - i) if words[k] != words[i + k]), len(words) - i) for i in range(min(most, len(words)))]
        assert z_values(words, most) == want
