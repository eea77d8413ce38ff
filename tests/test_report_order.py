"""Reports sort by the values they show, not by the text they show them as."""

import datetime


from tidemark.operators.filters import as_ntz
from tidemark.plans import health as R

SESSION = (
    "inst_id int, sid int, serial_no int, username string, status string, sql_address string, sql_hash_value int, sql_id string, event string, "
    "osuser string, program string, module string, machine string, seconds_in_wait int, state string, logon_time timestamp_ntz, last_call_et int"
)


def test_longest_running_first(spark):
    at = datetime.datetime(2024, 1, 1)
    seconds = {1: 99 * 3600, 2: 100 * 3600, 3: 5}
    rows = [(1, sid, 1, "u", "ACTIVE", "a", 1, "q", "e", "o", "p", "m", "h", 0, "s", at, s) for sid, s in seconds.items()]
    texts = spark.createDataFrame([(1, "a", 1, 1, 1, 1, 1, "select")], "inst_id int, address string, hash_value int, plan_hash_value int, disk_reads int, buffer_gets int, rows_processed int, sql_text string")
    assert [r.sid for r in R.in_flight(spark.createDataFrame(rows, SESSION), texts).collect()] == [2, 1, 3]


def test_newest_alert_first_over_a_month_end(spark):
    times = [datetime.datetime(2024, 1, 31, 23, 0), datetime.datetime(2024, 2, 1, 1, 0), datetime.datetime(2024, 1, 31, 12, 0)]
    rows = [(t, 1, "rdbms", "ORA-1", "h", "/") for t in times]
    df = spark.createDataFrame(rows, "originating_timestamp timestamp_ntz, inst_id int, component_id string, message_text string, host_id string, adr_home string")
    got = R.alert_errors(df, as_ntz("2024-02-01 02:00:00")).collect()
    assert [r.message_time[:2] for r in got] == ["01", "31", "31"] and got[1].message_time.endswith("23:00:00")


def test_samples_in_time_over_midnight(spark):
    times = [datetime.datetime(2024, 1, 2, 0, 0, 30), datetime.datetime(2024, 1, 1, 23, 59, 30)]
    rows = [(t, None, 1, 5, 9 << 20, "q", "m", "p") for t in times]
    df = spark.createDataFrame(rows, "sample_time timestamp_ntz, qc_session_id int, inst_id int, session_id int, pga_allocated long, sql_id string, module string, program string")
    got = R.private_memory(df, as_ntz("2024-01-02 00:01:00")).collect()
    assert [r.hhmmss for r in got] == ["23:59:30", "00:00:30"]


def test_first_seen_order_is_kept(spark):
    from tidemark.operators.joins import unique_in_order

    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), ("c", 4), ("a", 5)], "v string, n int").repartition(4)
    assert [(r.v, r.first_position) for r in unique_in_order(df, ["v"], "n").collect()] == [("b", 1), ("a", 2), ("c", 4)]
