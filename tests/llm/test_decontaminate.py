import random

from tidemark.llm.decontaminate import Automaton, benchmark_hits, contamination_digest, remove_contaminated, words_of


def brute(text, items, window=13):
    words = words_of(text)
    hit, found = set(), set()
    for name, item in items:
        own = words_of(item)
        size = min(window, len(own))
        runs = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if own else set()
        for k in range(len(words) - size + 1):
            if own and tuple(words[k : k + size]) in runs:
                hit.update(range(k, k + size))
                found.add(name)
    return len(words), hit, found


def corpus(seed, letters):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice(letters) for _ in range(draw.randint(1, 2)))
    line = lambda n: " ".join(word() for _ in range(n))
    items = [(str(k), line(draw.choice([1, 2, 5, 12, 13, 14, 30]))) for k in range(12)] + [("z", ""), ("n", None), ("0", line(3))]
    texts = []
    for _ in range(30):
        parts = [line(draw.randint(0, 20))]
        for _, item in draw.sample(items, 3):
            own = words_of(item)
            a = draw.randint(0, max(0, len(own) - 1))
            parts += [" ".join(own[a : a + draw.randint(1, 30)]).upper(), line(draw.randint(0, 9))]
        texts.append("; ".join(parts))
    return items, texts


def test_hits_equal_brute_force(spark, documents):
    for seed, letters in ((1, "ab"), (2, "abcdefgh"), (3, "aé中0")):
        items, texts = corpus(seed, letters)
        bench = spark.createDataFrame(items, "item_id string, text string")
        df = documents(list(enumerate(texts)))
        for block_words in (10**6, 20):
            rows = benchmark_hits(df, bench, block_words=block_words).collect()
            assert len(rows) == len(texts)
            for row in rows:
                n, hit, found = brute(row["text"], items)
                spans = [range(h["first"], h["end"]) for h in row["hits"]]
                assert row["n_words"] == n and {k for s in spans for k in s} == hit and sum(map(len, spans)) == len(hit)
                assert row["items"] == sorted(found)


def test_automaton_holds_every_run():
    items = [("a", "x y x y z".split()), ("b", "y x y z z".split())]
    made = Automaton(items, 3)
    ids = [made.vocabulary[w] for w in "x y z z".split()]
    assert {(p, made.names[i]) for p, _, i in made.hits(ids)} == {(2, "a"), (2, "b"), (3, "b")}


def test_rows(spark, documents):
    bench = spark.createDataFrame([("q", "one two three"), (None, "four five")], "item_id string, text string")
    rows = [(1, "One, two; THREE"), (2, None), (3, ""), (4, "One, two; THREE"), (5, "w " * 99 + "one two three"), (None, "four five")]
    df = documents(rows).withColumnRenamed("source", "items")
    got = {r["doc_id"]: r for r in contamination_digest(df, bench).collect()}
    assert got[1]["contaminated"] and got[4]["contaminated"] and got[None]["contaminated"]
    assert not got[2]["contaminated"] and got[2]["n_words"] == 0 and not got[5]["contaminated"] and got[5]["n_hit"] == 3
    kept = remove_contaminated(df, bench)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 5]
    assert {r["items"] for r in kept.collect()} == {"src0"}
    cut = {r["doc_id"]: r["text"] for r in remove_contaminated(df, bench, longest=2).collect()}
    assert cut[5] == "w " * 99 and cut[2] is None and cut[3] == ""
    assert contamination_digest(df.where("false"), bench).count() == 0
    assert contamination_digest(df, bench.where("false")).where("contaminated").count() == 0
