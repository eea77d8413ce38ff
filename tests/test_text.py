import random
import re
from html.parser import HTMLParser

from pyspark.sql import functions as F

from tidemark.operators import logs as C
from tidemark.sources import files as S
from tidemark.sources import text as P
from tidemark.specs import LEADER_RULES


def lines(spark, texts, node="n1"):
    return spark.createDataFrame([(node, "f", i, t) for i, t in enumerate(texts)], "node string, file string, line_no bigint, line string")


def test_kv_first_non_empty_spelling_wins(spark):
    rows = spark.createDataFrame(
        [("h", 1, "Replica_IO_Running:  "), ("h", 2, "  Slave_IO_Running: Yes"), ("h", 3, "Last_Error: a: b"), ("h", 4, "junk")],
        "host string, line_no int, line string",
    )
    row = P.parse_kv_status(rows, P.REPLICA_FIELDS).collect()[0]
    assert (row.io_running, row.last_error, row.sql_running) == ("Yes", "a: b", None)


def test_param_lines(spark):
    rows = lines(spark, ["EM_CELLS=(c1 c2  c3)", "swiib1.x name= s1 ", "pdu name=p", "swikvm.name=k", "other=1", "EM_CELLS=()"])
    got = {(r.component_type, r.host) for r in P.parse_param_lines(rows).collect()}
    assert got == {("cell", "c1"), ("cell", "c2"), ("cell", "c3"), ("switch", "s1"), ("pdu", "p"), ("kvm", "k")}


def test_whitespace_table_keeps_rejects(spark):
    rows = P.parse_whitespace_table(lines(spark, ["a 1", "bad"]), r"^(\S+) (\d+)$", ["n", "v"]).orderBy("line_no").collect()
    assert [(r.n, r.v, r.rejected) for r in rows] == [("a", "1", None), (None, None, "bad")]


def test_block_records_do_not_depend_on_the_chunk(spark):
    texts = ["NAME=a", "Port: 1", "", "NAME=b", "", "", "port=3", "NAME=c"]
    for width in (1, 3, 100):
        got = P.parse_block_records(lines(spark, texts), ["node"], {"NAME": "name", "PORT": "port"}, width).collect()
        assert {(r.name, r.port, r.rejected) for r in got} == {("a", "1", False), ("b", None, True), ("c", "3", False)}


def test_html(spark):
    html = '<html><!-- x --><script>var a="<p>";</script><h1>T &amp; U</h1><p>a <b>b</b><br>file: gone</p>&lt;c&gt;</html>'
    text = spark.range(1).select(P.html_to_text(F.lit(html)).alias("x")).collect()[0].x
    assert text == "T & U\na b\n<c>"


def shown(spark, pages):
    rows = spark.createDataFrame([(k, p) for k, p in enumerate(pages)], "k int, html string")
    return [r.text for r in rows.select("k", P.html_to_text(F.col("html")).alias("text")).orderBy("k").collect()]


def test_attributes_comments_and_references(spark):
    pages = {
        '<p title="a > b">caf&eacute; &#8212;': "caf\u00e9 \u2014", "<p title='x>y' class=it's>z</p>": "z", '<a href="no end>text</a>': "text",
        "1 < 2 &amp;lt; <b x=1/>c": "1 < 2 &lt; c", "<!-- a > b --> <!DOCTYPE html><SCRIPT>if (a < b) {'</p>'}</SCRIPT >d": "d",
        "&#x1F600;&#0;&#xD800;&#150;&#99999999;&nosuch;&amp": "\U0001f600\ufffd\ufffd\u2013\ufffd&nosuch;&amp", "&#65 &#x42;&apos;&&": "A B'&&",
        "<preface>x</preface><pre>y": "xy", "<br/>a<br>b<P>c": "a\nb\nc", "": "", "<p": "<p", "&": "&",
    }
    assert dict(zip(pages, shown(spark, list(pages)))) == pages
    assert shown(spark, [None]) == [None]


class _Words(HTMLParser):
    """Text by the parser of the standard library."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.out, self.skip = [], 0
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.skip += tag in P.RAW
        self.out.append("\n" if re.fullmatch("|".join(P.BLOCKS), tag) else "")

    def handle_startendtag(self, tag, attrs):
        self.out.append("\n" if re.fullmatch("|".join(P.BLOCKS), tag) else "")

    def handle_endtag(self, tag):
        self.skip -= tag in P.RAW
        self.out.append("\n" if re.fullmatch("|".join(P.BLOCKS), tag) else "")

    def handle_data(self, data):
        self.out.append("" if self.skip else data)


def test_random_pages_equal_a_parser(spark):
    draw = random.Random(4)
    parts = [
        "word ", "caf&eacute; ", "&#8364;", "&#x263a; ", "&lt;b&gt;", "<b>", "</b>", '<p title="a > b">', "<div class='x>y' id=z>", "</div>", "<br/>",
        "<script>var x = '<p>' + 1;</script>", "<style>p > b</style>", "<!-- <p> - > x -->", "<!doctype html>", '<img alt="&quot;>" src=a>', "\n", "R&amp;D ", "2 > 1 ",
    ]
    pages = ["".join(draw.choice(parts) for _ in range(draw.randint(1, 25))) for _ in range(300)]
    want = []
    for page in pages:
        lines = [re.sub("[ \t\r\u00a0]+", " ", line).strip(" ") for line in "".join(_Words(page).out).split("\n")]
        want.append("\n".join(line for line in lines if line and not line.startswith("file:")))
    assert shown(spark, pages) == want


def test_whole_text_is_kept(spark):
    long = "<p>" + "word " * 50000 + "</p>"
    text = spark.range(1).select(P.html_to_text(F.lit(long)).alias("x")).collect()[0].x
    assert len(text.split(" ")) == 50000


def test_leader_is_named_by_the_newest_line(spark):
    rows = lines(spark, ["2024-01-01 10:00:00.500 I AM THE NEW OCR MASTER at incar 1"], "n1").unionByName(
        lines(spark, ["2024-01-01 10:00:00.400 NEW OCR MASTER IS 9", "2024-01-02 00:00:00 NEW OCR MASTER IS 2", "no time here"], "n3")
    )
    roster = spark.createDataFrame([(2, "n2")], "id int, name string")
    row = C.leaders(rows, LEADER_RULES, roster).collect()[0]
    assert (row.role, row.leader) == ("registry", "n2")


def test_leader_without_a_roster_entry(spark):
    roster = spark.createDataFrame([(2, "n2")], "id int, name string")
    rows = lines(spark, ["2024-01-01 10:00:00 NEW OCR MASTER IS 7"])
    assert C.leaders(rows, LEADER_RULES, roster).collect()[0].leader == "N/A"


def test_storage_connection_ties_are_listed(spark):
    event = "NOTE: client c1 opening"
    rows = lines(spark, ["2024-01-01 00:00:00", event], "s1").unionByName(
        lines(spark, ["2024-01-01 00:00:00", event], "s2")).unionByName(lines(spark, ["2023-01-01 00:00:00", event], "s3"))
    row = C.storage_connections(rows, r"^NOTE: client (\S+) opening", 1).collect()[0]
    assert row.servers == "s1,s2"


def test_suppress_repeats(spark):
    rows = spark.createDataFrame([("g", 1), ("g", 2), ("h", 3)], "g string, n int")
    got = C.suppress_repeats(rows.withColumn("shown", F.col("g")), "g", "n", ["shown"], F.floor(F.col("n") / 2)).orderBy("n")
    assert [r.shown for r in got.collect()] == ["g", "", "h"]


def test_roster_rejects_and_derives_roles(spark):
    texts = ["a 1 Active Hub", "b 150 Inactive None", "c 7 Inactive None", "d 0 Active Hub", "junk"]
    got = {r.name: r.role for r in C.node_roster(lines(spark, texts)).collect()}
    assert got == {"a": "Hub", "b": "Leaf", "c": "Hub"}


def test_generated_numbers_repeat_and_spread(spark):
    a = S.generate_series_table(spark, 2000, 1).collect()
    b = S.generate_series_table(spark, 2000, 1).repartition(3).collect()
    assert sorted(a) == sorted(b)
    assert {r.num1 for r in a} == set(range(11)) and all(0 <= r.num2 < 1 and 0 <= r.num3 < 142 for r in a)


def test_csv_round_trip_keeps_every_text(spark, tmp_path):
    texts = ["plain", "", None, "two\nlines", "a\r\nb", 'say "so"', '"', " spaced ", "a,b", "\\N", "\\\\N", "\\", "N", "é😀", '\n"\n,', "#x"]
    rows = spark.createDataFrame([(n, t, None if n % 2 else 1.5) for n, t in enumerate(texts)], "n int, t string, v double")
    S.export_csv(rows, str(tmp_path / "t"))
    back = S.import_csv(spark, str(tmp_path / "t"), rows.schema)
    assert sorted(back.collect()) == sorted(rows.collect())


def test_a_report_written_twice_is_there_once(spark, tmp_path):
    rows = spark.range(3)
    for _ in range(2):
        S.write_report(rows, str(tmp_path / "r"), "a", "run1")
    S.write_report(spark.range(5), str(tmp_path / "r"), "b", "run1")
    assert S.read_report(spark, str(tmp_path / "r"), "a", "run1").count() == 3


def test_parallel_lists_of_unequal_length_are_rejected(spark):
    lines = ["Name: a", "Subnet: 1", "noise", "Name: b", "Subnet: 2"]
    rows = [("n1", k, x) for k, x in enumerate(lines)] + [("n2", k, x) for k, x in enumerate(lines[:4])]
    df = spark.createDataFrame(rows, "node string, line_no int, line string")
    got = P.parse_parallel_lists(df, ["node"], {"name": "^Name: (.*)$", "subnet": "^Subnet: (.*)$"}).collect()
    assert {(r.node, r.name, r.subnet, r.rejected) for r in got} == {
        ("n1", "a", "1", False), ("n1", "b", "2", False), ("n2", "a", "1", True), ("n2", "b", None, True)}


def test_xml_needs_a_known_kind(spark):
    import pytest

    with pytest.raises(ValueError):
        S.read_components_xml(spark, "/nowhere", "other")
