import random
import uuid

import pytest

from tidemark.operators.counters import counter_delta
from tidemark.operators.layout import land_series, series_delta
from tidemark.session import work_folder


def landed(spark, rows, schema, keys, width, buckets=4):
    table = f"series_{uuid.uuid4().hex}"
    land_series(spark.createDataFrame(rows, schema), table, work_folder(spark, "series"), keys, "n", width, buckets)
    return table


@pytest.mark.parametrize("width", [1, 7, 1000])
@pytest.mark.parametrize("modes", [("clamp", "null"), ("raw", "full"), ("null", "full")])
def test_equals_counter_delta(spark, width, modes):
    draw = random.Random(width)
    rows = [("hot", None, n, draw.randrange(50)) for n in range(300)]
    rows += [(draw.choice(["a", None]), draw.choice(["x", None]), n, draw.choice([None, draw.randrange(9)])) for n in draw.sample(range(10_000), 200)]
    schema = "k string, l string, n bigint, v bigint"
    table = landed(spark, rows, schema, ["k", "l"], width)
    got = series_delta(spark, table, ["k", "l"], "n", ["v"], *modes)
    want = counter_delta(spark.createDataFrame(rows, schema), ["k", "l"], ["n"], ["v"], 1000, *modes)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    with pytest.raises(ValueError):
        series_delta(spark, table, ["k", "l"], "n", ["v"], "up", "full")


def test_rows_are_not_shuffled(spark):
    """What is exchanged is one row per key and stretch; the wide column of the rows is in no exchange."""
    table = landed(spark, [("a", n, n * n, "wide" * 9) for n in range(500)], "k string, n bigint, v bigint, wide string", ["k"], 50)
    key, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"
    before = {name: spark.conf.get(name) for name in (key, adaptive)}
    spark.conf.set(key, "-1")
    spark.conf.set(adaptive, "false")
    try:
        df = series_delta(spark, table, ["k"], "n", ["v"])
        plan = df._jdf.queryExecution().executedPlan()
        lines = plan.toString().splitlines()
        exchanges = [line for line in lines if "Exchange" in line]
        # Below an exchange stand only the aggregated edges.
        for k, line in enumerate(lines):
            if "Exchange" in line:
                depth = len(line) - len(line.lstrip(" :+-"))
                below = [after for after in lines[k + 1:] if len(after) - len(after.lstrip(" :+-")) > depth]
                assert any("Aggregate" in after for after in below)
        assert exchanges and not any("wide" in line for line in exchanges)
        assert df.count() == 500
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_a_row_needs_a_position(spark):
    with pytest.raises(Exception, match="without a position"):
        landed(spark, [("a", None, 1)], "k string, n bigint, v bigint", ["k"], 5)
