import base64
import hashlib
import random

import pytest

from tidemark.llm.warc import archived_captures, loser_tree, read_captures, records_of, url_key, write_archives
from tidemark.session import work_folder


def test_loser_tree_merges():
    draw = random.Random(1)
    for _ in range(500):
        runs = [sorted(draw.randint(0, 9) for _ in range(draw.randint(0, 6))) for _ in range(draw.randint(0, 9))]
        assert list(loser_tree(runs, lambda x: x)) == sorted(x for run in runs for x in run)


def test_url_keys():
    assert url_key("https://www.Example.com:80/A/b?x=1#f") == url_key("http://example.com/a/B?X=1") == "com,example)/a/b?x=1"
    assert url_key("http://a.b.c") == "c,b,a)/" and url_key("") == "" and url_key("no url") == "no url"


ROWS = [
    (5, "http://b.example.com/x", "<p>one</p>"), (2, "http://a.example.com/", "<p>one</p>"), (9, None, None), (4, "http://a.example.com/\r\nX: y", ""),
    (7, "not a url", "WARC/1.1\r\nContent-Length: 5\r\n\r\n\r\n\r\nWARC/1.1\r\n"), (None, "http://c.example.com/", "<p>one</p>"), (8, "http://d.example.com/", "é😀" * 50_000),
    (2, "http://a.example.com/", "<p>one</p>"), (1, "http://e.example.com/", "lone\r\n\r\n"),
]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, size string")


def test_round_trip(spark):
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in archived_captures(pages(spark, ROWS)).collect()), key=str)
    least = {}
    for k, _, html in ROWS:
        if k is not None:
            least[html or ""] = min(k, least.get(html or "", k))
    want = []
    for k, _, html in ROWS:
        raw = (html or "").encode()
        first = least.get(html or "")
        same = k == first
        want.append((k, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if same else "revisit", None if same else first))
    assert got == sorted(want, key=str)
    assert archived_captures(pages(spark, ROWS).where("false")).count() == 0


def test_histories_are_in_order(spark):
    draw = random.Random(3)
    rows = [(k, f"http://{draw.choice('abc')}.org/{draw.randint(0, 3)}", f"body {draw.randint(0, 50)}") for k in range(300)]
    got = archived_captures(pages(spark, rows)).orderBy("range", "place").collect()
    order = [(r["url_key"], r["captured"], r["page_id"]) for r in got]
    assert order == sorted(order) and len(order) == 300
    before = {}
    for r in got:
        assert r["previous"] == before.get((r["range"], r["url_key"]))
        before[(r["range"], r["url_key"])] = r["page_id"]


def test_damage_is_found(spark):
    folder = work_folder(spark, "archives")
    write_archives(pages(spark, ROWS[:3]), folder, compression="none")
    assert read_captures(spark, folder).count() == 3
    with pytest.raises(ValueError):
        list(records_of(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nshort\r\n\r\n"))
    with pytest.raises(ValueError):
        list(records_of(b"something else\r\n\r\n"))
