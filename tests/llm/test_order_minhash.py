import hashlib
import random

import numpy as np

from tidemark.llm.order_minhash import PICKED, RUN, SLOTS, _ADD, _ODD, compare_edited, fingerprints, likeness, run_codes, slots_of, written
from tidemark.llm.words import mixed


def brute_slots(text):
    """Slot by slot with plain loops."""
    codes = [int(c) for c in run_codes(text)]
    if not codes:
        return np.zeros(SLOTS, np.uint32)
    seen, points = {}, []
    mask = 0xFFFFFFFF
    for place, code in enumerate(codes):
        high = code >> 32
        seen[high] = seen.get(high, -1) + 1
        value = int(mixed(np.array([(high * 0x9E3779B97F4A7C15 + seen[high]) & (2**64 - 1)], np.uint64))[0])
        points.append((high, seen[high], place, value))
    out = []
    for odd, add in zip(_ODD.tolist(), _ADD.tolist()):
        least = sorted(points, key=lambda p: (((p[3] & mask) * odd + add) & mask, p[0], p[1]))[:PICKED]
        state = PICKED
        for _, _, _, value in sorted(least, key=lambda p: p[2]):
            state = int(mixed(np.array([(state * 0xD1342543DE82EF95 + value) & (2**64 - 1)], np.uint64))[0])
        out.append((state >> 32) | 1)
    return np.array(out, np.uint32)


def test_slots_equal_brute_force():
    draw = random.Random(4)
    for text in ["", "a", "abcd", "abcde", "aaaaaaaaaaaa", "é😀中文x́" * 3] + ["".join(draw.choice("abc ") for _ in range(draw.randint(6, 200))) for _ in range(40)]:
        assert (slots_of(run_codes(text)) == brute_slots(text)).all(), text


def test_order_matters():
    one = " ".join(f"word{k}" for k in range(300))
    swapped = " ".join(f"word{k}" for k in [*range(150, 300), *range(150)])
    near = one.replace("word77", "words77")
    slots = lambda t: slots_of(run_codes(t))
    assert likeness(slots(one), slots(one)) == 1
    assert likeness(slots(one), slots(near)) > likeness(slots(one), slots(swapped)) > 0
    assert RUN == 5


def test_edited_texts_equal_brute_force(documents):
    draw = random.Random(9)
    ids = draw.sample(range(100_000), 400)
    rows = [(k, "".join(draw.choice("ab é😀") for _ in range(draw.choice([0, 1, 2, 7, 60])))) for k in ids]
    rows[3], rows[4] = (rows[3][0], None), (rows[4][0], rows[5][1])
    got = {r["doc_id"]: r for r in compare_edited(documents(rows)).collect()}
    rows.sort(reverse=True)
    for k, (key, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        row = got[key]
        assert (row["n_chars"], row["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = (slots_of(run_codes(t)) for t in (text, edited, following))
        assert (row["fingerprint"], row["edited_fingerprint"]) == (written(a), written(b))
        assert (row["near_edited"], row["near_next"]) == (likeness(a, b), likeness(a, c))


def test_hot_ids_are_cut(documents, monkeypatch):
    """A third of the rows without an id and a third with one: the same neighbours, in many partitions."""
    import collections

    from tidemark.llm import order_minhash as M

    monkeypatch.setattr(M, "STRETCH", 20)
    draw = random.Random(11)
    text = lambda: "".join(draw.choice("abc ") for _ in range(draw.choice([0, 3, 8, 30])))
    rows = [(None, text()) for _ in range(600)] + [(77, text()) for _ in range(600)] + [(k, text()) for k in range(600)]
    df = documents(rows)
    placed = M.in_descending_order(df, "doc_id", "text")
    parts = collections.Counter(r[0] for r in placed.where("not carried").selectExpr("spark_partition_id()").collect())
    texts = collections.Counter(t for _, t in rows)
    assert max(parts.values()) <= 100 + max(texts.values())
    hashes = {r["text"]: r["h"] for r in df.selectExpr("text", "xxhash64(text) AS h").distinct().collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]], r[1]))
    want = collections.Counter()
    for k, (key, own) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        half = len(own) // 2
        want[key, hashlib.sha256((own[: len(own) - half] + following[:half]).encode()).hexdigest()] += 1
    got = collections.Counter((r["doc_id"], r["edited_sha256"]) for r in compare_edited(df).collect())
    assert got == want


def test_rows(documents):
    rows = [(1, "some text here"), (2, None), (2, ""), (None, "lost id"), (3, "some text here"), (3, "some text here"), (9, "z" * 60_000)]
    df = documents(rows).withColumnRenamed("source", "fingerprint")
    got = compare_edited(df).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(k) for k, _ in rows)
    assert len({r["fingerprint"] for r in got if r["n_chars"] == 14}) == 1
    assert len({r["fingerprint"] for r in got if r["n_chars"] == 0}) == 1
    assert fingerprints(df).columns.count("fingerprint") == 1
    alone = compare_edited(documents([(5, "abcdef")])).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and alone["near_next"] == 1
    assert compare_edited(df.where("false")).count() == 0
