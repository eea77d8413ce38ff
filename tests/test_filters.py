import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import filters as P


def test_like_filters(spark):
    rows = spark.createDataFrame([("abc", "x"), ("abd", "y"), (None, "x")], "a string, b string")
    assert P.like_filters(rows, {"a": "ab%", "b": "x"}).count() == 1
    assert P.like_filters(rows, {"a": "", "b": None}).count() == 3
    with pytest.raises(ValueError):
        P.like_filters(rows, {"nothing": "%"})


def test_choose_instances(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "inst_id int")
    names = {"db1": 1, "db2": 2, "db3": 3}
    assert P.choose_instances(rows, names, "ALL").count() == 3
    assert [r.inst_id for r in P.choose_instances(rows, names, "CURRENT", "DB2").collect()] == [2]
    assert P.choose_instances(rows, names, ["db1", "DB3"]).count() == 2
    for wrong in ("db9", "CURRENT"):
        with pytest.raises(ValueError):
            P.choose_instances(rows, names, wrong)


def test_windows_at_their_borders(spark):
    noon = datetime.datetime(2024, 1, 2, 12)
    stamps = [noon, noon - datetime.timedelta(hours=1), noon - datetime.timedelta(hours=1, microseconds=1), noon + datetime.timedelta(seconds=1)]
    rows = spark.createDataFrame([(s,) for s in stamps], "ts timestamp_ntz")
    as_of = P.as_ntz(noon)
    assert rows.filter(P.trailing_window(F.col("ts"), as_of, 3600)).count() == 2
    assert rows.filter(P.since(F.col("ts"), as_of, 3600)).count() == 1


def test_same_day_is_half_open(spark):
    days = ["2024-01-01 23:59:59.999999", "2024-01-02 00:00:00", "2024-01-02 23:59:59", "2024-01-03 00:00:00"]
    rows = spark.createDataFrame([(d,) for d in days], "d string").select(F.col("d").cast("timestamp_ntz").alias("ts"))
    assert rows.filter(P.same_day(F.col("ts"), "2024-01-02 12:00:00")).count() == 2
