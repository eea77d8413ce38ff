"""The two learned operators by held-out accuracy, on the small tables and on planted rows."""

import random
import zlib

import numpy as np

from tests.conftest import SF
from tidemark.llm.language import document_vectors, identify_languages, language_digest, learn_languages, letter_table, run_vectors, runs_of
from tidemark.llm.quality import ENCODED, KINDS, gradients, forward, learn_quality, new_model, passages, quality_digest, score_quality


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_run_vectors_are_nearly_orthogonal():
    letters = letter_table()
    vectors = run_vectors(np.unique(runs_of("the quick brown fox jumps over the lazy dog", letters)))
    off = vectors @ vectors.T / vectors.shape[1] - np.eye(len(vectors))
    assert abs(off).max() < 0.2
    turned = run_vectors(np.unique(np.concatenate([runs_of("abc", letters), runs_of("cba", letters)])))
    assert abs(turned @ turned.T / turned.shape[1] - np.eye(len(turned))).max() < 0.2


def test_document_vectors_equal_brute_force():
    letters = letter_table()
    texts = ["Ab c", "", "12 !", "é" * 9, "the cat the cat"]
    got = np.concatenate([v for _, v in document_vectors(texts, letters)])
    for text, vector in zip(texts, got):
        runs = runs_of(text, letters)
        total = np.zeros(vector.shape) if runs is None else sum(run_vectors(np.array([r]))[0].astype(float) for r in runs)
        length = np.linalg.norm(total)
        assert np.allclose(vector, total / length if length else total, atol=1e-5)


def test_languages_of_held_out_rows(spark):
    docs = table(spark, "documents")
    langs = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = language_digest(docs).collect()
    assert len(rows) == len(langs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    out = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in out) >= 0.95 * len(out)


def test_language_rows(spark, documents):
    profiles = learn_languages(table(spark, "documents"))
    df = documents([(1, None), (2, ""), (3, "123 !?"), (4, "the and of"), (5, "the and of"), (None, "the and " * 9000)]).withColumnRenamed("source", "score")
    got = {r["doc_id"]: r for r in identify_languages(df, profiles).collect()}
    assert [got[k]["lang_pred"] for k in (1, 2, 3)] == ["und"] * 3 and got[1]["score"] == 0
    assert got[4]["lang_pred"] == got[5]["lang_pred"] == got[None]["lang_pred"] == "en"
    assert language_digest(df.where("false")).count() == 0
    assert {r["lang_pred"] for r in identify_languages(df, {}).collect()} == {"und"}


def test_gradients_equal_differences():
    draw = np.random.default_rng(1)
    rows, firsts, labels = draw.random((7, KINDS * KINDS)), np.array([0, 2, 3, 7]), np.array([1.0, 0.0, 1.0])
    model = new_model()

    def loss():
        p = forward(model, rows, firsts)["score"]
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    grads = gradients(model, rows, firsts, labels)
    for name in ("encode", "encode_bias", "view", "gate", "weigh", "judge"):
        place = tuple(draw.integers(0, n) for n in model[name].shape)
        kept = model[name][place]
        model[name][place] = kept + 1e-5
        above = loss()
        model[name][place] = kept - 1e-5
        below = loss()
        model[name][place] = kept
        assert abs((above - below) / 2e-5 - grads[name][place]) < 1e-6
    assert model["judge"].shape == (ENCODED,)


def test_attention_finds_the_odd_passage():
    """A model learned on documents of one kind each still scores every passage: weights sum to one in each document."""
    draw = random.Random(2)
    text = " ".join(draw.choice(["some", "plain", "words"]) for _ in range(900)).encode()
    offsets = np.array([0, 0, len(text)])
    table_, firsts = passages(np.frombuffer(text, np.uint8), offsets)
    assert firsts.tolist() == [0, 1, 1 + -(-len(text) // 512)]
    step = forward(new_model(), table_, firsts)
    assert np.allclose(np.add.reduceat(step["weight"], firsts[:-1]), 1)


def test_quality_of_held_out_rows(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    want = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = quality_digest(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    out = [r for r in rows if r["held_out"] and r["doc_id"] in want]
    assert sum(r["predicted"] == want[r["doc_id"]] for r in out) >= 0.93 * len(out)
    other = quality_digest(docs, labels).collect()
    assert {r["doc_id"]: r["score"] for r in rows} == {r["doc_id"]: r["score"] for r in other}


def test_quality_rows(spark, documents):
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(None, 1), (3, None), (4, 1)], "doc_id long, quality int")
    rows = [(k, "plain words here " * 5 if k % 2 else "$$$ !!! %%% " * 5) for k in range(40)] + [(100, None), (101, ""), (102, "q" * 300_000), (None, "plain")]
    df = documents(rows).withColumnRenamed("source", "predicted")
    model = learn_quality(df, labels)
    scored = score_quality(df, model)
    assert scored.columns.count("predicted") == 1 and scored.count() == len(rows)
    got = {r["doc_id"]: r for r in quality_digest(df, labels).collect()}
    assert got[100]["score"] == got[101]["score"] and got[None]["held_out"] is False
    assert all(got[k]["predicted"] == k % 2 for k in range(40) if k != 4)
    assert {r["score"] for r in quality_digest(df, labels.where("false")).collect()} == {0.5}
    assert quality_digest(df.where("false"), labels).count() == 0
