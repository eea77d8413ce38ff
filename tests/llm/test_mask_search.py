import collections
import math
import random
import re

import numpy as np
import pytest

from tidemark.llm.mask_search import Block, index_blocks, length_measures, ranked_search, term_weight

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
LOWER = {code: code + 32 for code in range(65, 91)}


def words_of(text):
    return [w.translate(LOWER) for w in WORD.findall(text or "")]


def brute(rows, items, best=50):
    docs = [(key, collections.Counter(words_of(text)), len(words_of(text))) for key, text in rows]
    docs = [d for d in docs if d[2]]
    total, words = len(docs), sum(d[2] for d in docs)
    holders = collections.Counter(t for _, tf, _ in docs for t in tf)
    out = []
    for item, text in items:
        scored = []
        for key, tf, n in docs:
            m = 100 - 50 + (50 * n * total) // words
            score = sum(
                math.floor(1000 * math.log((2 * total + 2) / (2 * holders[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 20 * m))
                for t in set(words_of(text)) if t in tf
            )
            if score > 0:
                scored.append((-score, key is None, key, score))
        out += [(item, k + 1, key, score) for k, (_, _, key, score) in enumerate(sorted(scored, key=lambda s: s[:2] + ((0,) if s[1] else (s[2],)))[:best])]
    return sorted(out, key=str)


def frames(spark, rows, items):
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")


@pytest.mark.parametrize("block_words, item_terms, probed", [(1_000_000, 200_000, 64), (40, 5, 2), (300, 12, 1)])
def test_equals_brute_force(spark, block_words, item_terms, probed):
    draw = random.Random(block_words)
    vocabulary = [f"w{k}" for k in range(60)] + ["Ä", "😀x", "Ab", "aB"]
    common = vocabulary[:6]
    text = lambda n: draw.choice([" ", ", ", "\n"]).join(draw.choice(common if draw.random() < 0.4 else vocabulary) for _ in range(n))
    rows = [(k, text(draw.choice([0, 1, 2, 8, 30]))) for k in draw.sample(range(5000), 400)]
    # Copies in numbers beyond the results of an item, whose order is that of their ids.
    rows += [(10_000 + k, "w1 w2 w3 w50") for k in range(120)] + [(-1, None), (-2, ""), (-3, "?!")]
    items = [(f"q{k}", text(draw.choice([1, 3, 12]))) for k in range(12)] + [("same", "w50 w1"), ("same", "w50 w1"), ("none", None), ("far", "nowhere"), ("all", " ".join(vocabulary * 2))]
    df, bench = frames(spark, rows, items)
    got = ranked_search(df.repartition(3), bench, block_words=block_words, item_terms=item_terms, probed=probed)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and dict(got.dtypes)["rank"] == "int"
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, items)


def test_more_terms_than_a_word_has_bits(spark):
    draw = random.Random(3)
    vocabulary = [f"t{k}" for k in range(300)]
    rows = [(k, " ".join(draw.sample(vocabulary, draw.randint(1, 120)))) for k in range(300)]
    items = [("long", " ".join(vocabulary[:200])), ("short", "t1")]
    assert sorted((tuple(r) for r in ranked_search(*frames(spark, rows, items)).collect()), key=str) == brute(rows, items)


def test_evaluates_few_masks_of_many():
    """A document with the rare term is found without scoring those that share only the common ones."""
    lengths = np.full(5000, 10, np.int32)
    terms = np.array([5, 9], np.uint64)
    places = np.concatenate([np.arange(5000), np.arange(60)]).astype(np.int32)
    row = {"lengths": lengths, "terms": terms, "ends": np.array([5000, 5060], np.int32), "places": places, "counts": np.ones(5060, np.int32)}
    block = Block(row, terms, np.array([1, term_weight(5000, 60)], np.int64), 5000, 50_000)
    scored = []
    whole = block.scores
    block.scores = lambda t, d: (scored.append(len(d)), whole(t, d))[1]
    who, points = block.best(np.array([0, 1]), 50, 1)
    assert sorted(who.tolist()) == list(range(60)) and len(set(points.tolist())) == 1
    assert sum(scored) == 60


def test_rows_and_clashing_columns(spark, documents):
    df = documents([(1, "one two"), (1, "one two"), (None, "one"), (2, None), (3, "z" * 100_000)]).withColumnRenamed("lang", "score").withColumnRenamed("source", "rank")
    bench = spark.createDataFrame([(5, "one", 1), (None, "two", 2)], "item_id long, text string, doc_id long")
    got = sorted((tuple(r) for r in ranked_search(df, bench).collect()), key=str)
    assert got == brute([(r["doc_id"], r["text"]) for r in df.collect()], [(5, "one"), (None, "two")])
    assert ranked_search(df.where("false"), bench).count() == 0 and ranked_search(df, bench.where("false")).count() == 0
    assert ranked_search(df, bench.where("false")).columns == ["item_id", "rank", "doc_id", "score"]
    assert index_blocks(documents([(1, None)])).count() == 0


def test_length_measures_beyond_64_bits():
    lengths = np.array([3, 2_000_000_000], np.int64)
    big = 10**12
    assert length_measures(lengths, big, 10**15).tolist() == [50 + (50 * big * n) // 10**15 for n in lengths.tolist()]
