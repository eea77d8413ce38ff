import gzip
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import logs as C
from tidemark.sources.lines import read_log_files


@pytest.fixture
def folder(tmp_path):
    """Two nodes, rotated and packed files, ends of every kind, an empty file and one without a last end."""
    draw = random.Random(3)
    files = {}
    for node in ("n1", "n2"):
        (tmp_path / node).mkdir()
        for name in ("crsd.log", "crsd.log.1", "crsd.log.2.gz", "a b+c%20.trc", "empty.log"):
            lines = [] if name == "empty.log" else [f"{node} {name} {k} " + "x" * draw.choice([0, 1, 30, 400]) for k in range(400)] + ["", "ümlaut 中", "last"]
            end = "\r\n" if name.endswith(".trc") else "\n"
            text = end.join(lines) + (end if name != "crsd.log.1" and lines else "")
            raw = text.encode()
            (tmp_path / node / name).write_bytes(gzip.compress(raw) if name.endswith(".gz") else raw)
            files[node, name] = lines
    return tmp_path, files


@pytest.mark.parametrize("most_sent", [0, 10**6])
def test_numbers_over_splits(spark, folder, most_sent):
    path, files = folder
    rows = read_log_files(spark, f"{path}/*", split_bytes=4096, most_sent=most_sent)
    got = {}
    for r in rows.collect():
        got.setdefault((r.node, r.file), {})[r.line_no] = r.line
    assert got == {k: dict(enumerate(lines, 1)) for k, lines in files.items() if lines}
    assert {(r.file, r.log, r.rotation) for r in rows.collect() if r.node == "n1"} == {
        ("crsd.log", "crsd.log", 0), ("crsd.log.1", "crsd.log", 1), ("crsd.log.2.gz", "crsd.log", 2), ("a b+c%20.trc", "a b+c%20.trc", 0),
    }


def test_one_file_is_read_by_many_tasks(spark, folder):
    path, files = folder
    rows = read_log_files(spark, f"{path}/n1/crsd.log", split_bytes=4096)
    assert rows.count() == 403
    size = (path / "n1" / "crsd.log").stat().st_size
    assert size > 4 * 4096
    landed = [p for p in rows.inputFiles() if "/read/" in p]
    assert len(landed) >= 4
    # A filtered read has the same numbers.
    assert [r.line_no for r in rows.filter(F.col("line") == "last").collect()] == [403]


def test_session_settings_stay(spark, folder):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    read_log_files(spark, f"{folder[0]}/n2", split_bytes=4096).count()
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_newest_is_by_stamp_and_file(spark):
    """Two files have a line 5; the order of the rows says nothing."""
    lines = [("n", "b", 5, "Active version on the cluster is [21]"), ("n", "a", 5, "Active version on the cluster is [12.1]"), ("n", "a", 9, "Active version on the cluster is [11]")]
    rules = [("version", r"Active version on the cluster is \[([0-9.]+)\]")]
    for order in (lines, lines[::-1]):
        df = spark.createDataFrame(order, "node string, file string, line_no int, line string")
        assert [r.value for r in C.facts(df, rules).collect()] == ["21"]
    stamped = [("n", "a", 9, "2024-01-01 00:00:00 Active version on the cluster is [1]"), ("n", "a", 2, "2024-01-02 00:00:00 Active version on the cluster is [2]")]
    assert [r.value for r in C.facts(spark.createDataFrame(stamped, "node string, file string, line_no int, line string"), rules).collect()] == ["2"]
    css = [("n", "a", 7, "Successful get misscount 30 for Cluster Synchronization Services."), ("n", "b", 1, "Successful get misscount 60 for Cluster Synchronization Services.")]
    assert C.timeouts(spark.createDataFrame(css, "node string, file string, line_no int, line string")).first().misscount == 60
    rotated = [("n", "x", 1, 7, "+ASM1:/h"), ("n", "x", 0, 1, "+ASM2:/h")]
    df = spark.createDataFrame(rotated, "node string, file string, rotation int, line_no int, line string")
    assert C.instance_names(df, df.filter("false"), "+ASM").first().instance == "+ASM2"
