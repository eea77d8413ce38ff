"""Both token operators against the library that defines them."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from tidemark.llm.merge_encoding import MergeEncoder, decode_pieces, encode_checked, encode_pieces, encoding_digest, load_merges
from tidemark.llm.pieces import _fields, read_model
from tidemark.llm.token_counts import PieceCounter, by_rank, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")
MIXED = [
    "a", "b", "the ", " ", "  ", "\n", "é", "x́", "😀", "▁", "\t", "0", "12", "中文", "Ο", "ing", "er", "\x00", "AAAA", "aaaa", '"', "'s", "   ", "!!!", "----", "====",
    "ﬁ", "�", "​", "ß", "<s>", "<0x0A>", "tion",
]


def texts(n, most):
    draw = random.Random(11)
    return ["".join(draw.choice(MIXED) for _ in range(draw.randint(0, most))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def encoder():
    return MergeEncoder(load_merges(PATH))


def test_encodes_and_decodes_as_the_library(library, encoder):
    cases = texts(1500, 30) + [" " * n + tail for n in range(40) for tail in ("", "a", " b", "\n")] + ["", " ", "▁", "ab" * 3000, "中" * 2000, "the of " * 2000]
    for text in cases:
        ids = library.encode(text)
        assert encoder.encode(text) == ids
        assert encoder.decode(ids) == library.decode(ids)
        assert encoder.decoded(encoder.written_ids(text)) == library.decode(ids)


def test_decodes_any_ids_as_the_library(library, encoder):
    draw = random.Random(5)
    for _ in range(300):
        ids = [draw.choice([draw.randrange(3, 259), draw.randrange(259, 32000)]) for _ in range(draw.randint(0, 12))]
        assert encoder.decode(ids) == library.decode(ids)


def test_memo_restarts_without_changing_results(library, monkeypatch):
    monkeypatch.setattr("tidemark.llm.merge_encoding.MEMO", 3)
    small = MergeEncoder(load_merges(PATH))
    for text in texts(100, 20):
        assert [int(k) for part in small.written_ids(text) for k in part.split(",")] == library.encode(text)


def test_rows(spark, documents, library):
    rows = [(1, "Hello  world\n"), (2, None), (3, ""), (4, "Hello  world\n"), (None, "x" * 5000), (5, " ")]
    df = documents(rows).withColumnRenamed("source", "ids")
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in encoding_digest(df.select("doc_id", "text"), PATH).collect()]
    want = []
    for key, text in rows:
        ids = library.encode(text or "")
        back = library.decode(ids)
        want.append((key, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert sorted(got, key=str) == sorted(want, key=str)
    encoded = encode_pieces(df, PATH)
    assert encoded.columns.count("ids") == 1 and {"text", "lang"} <= set(encoded.columns)
    assert sorted(r["ids"] for r in encoded.collect()) == sorted(library.encode(t or "") for _, t in rows)
    back = decode_pieces(encoded, PATH)
    assert sorted(r["decoded"] for r in back.collect()) == sorted(t or "" for _, t in rows)
    assert sorted(r["n_tokens"] for r in encode_checked(df, PATH).collect()) == sorted(len(library.encode(t or "")) for _, t in rows)
    empty = df.where("false")
    assert encoding_digest(empty, PATH).count() == 0 and encode_pieces(empty, PATH).count() == 0


def unigram_file(score):
    """The given file with other scores, marked as a unigram vocabulary."""

    def number(n):
        out = b""
        while True:
            byte, n = n & 127, n >> 7
            out += bytes([byte | (128 if n else 0)])
            if not n:
                return out

    def field(k, value):
        return number(k << 3 | 2) + number(len(value)) + value

    import struct

    with open(PATH, "rb") as file:
        raw = file.read()
    out = b""
    for k, (piece, _, kind) in enumerate(read_model(raw)["pieces"]):
        out += field(1, field(1, piece.encode()) + b"\x15" + struct.pack("<f", score(k)) + b"\x18" + number(kind))
    for k, value in _fields(raw):
        if k == 2:
            at = value.index(b"\x18\x02\x20")
            value = value[:at] + b"\x18\x01" + value[at + 2 :]
        if k != 1:
            out += field(k, value)
    return out


@pytest.mark.parametrize("score", [lambda k: -k / 1000, lambda k: -float(k % 50) - 1, None], ids=["fractions", "ties", "ranks"])
def test_counts_as_the_library(score):
    with open(PATH, "rb") as file:
        model = by_rank(read_model(file.read()))
    scores = [s for _, s, _ in model["pieces"]]
    proto = unigram_file(score or scores.__getitem__)
    library = sentencepiece.SentencePieceProcessor(model_proto=proto)
    counter = PieceCounter(read_model(proto))
    for text in texts(600, 25) + ["", " ", "\n", "words and other things " * 300]:
        assert counter.count(text) == len(library.encode(text)), text


def test_count_rows(spark, documents):
    with open(PATH, "rb") as file:
        counter = PieceCounter(by_rank(read_model(file.read())))
    rows = [(1, "some words here"), (2, None), (3, ""), (4, "some words here"), (None, "y" * 3000)]
    df = documents(rows).withColumnRenamed("n_chars", "n_tokens")
    got = token_counts(df, PATH, ranked=True)
    assert got.columns.count("n_tokens") == 1
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got.collect()) == sorted((str(k), counter.count(t)) for k, t in rows)
    assert token_counts(df.where("false"), PATH).count() == 0
