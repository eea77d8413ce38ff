"""The scalar functions that the reports are made of, one query per family."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalogue.registry import query


@query("fn_string", """
    SELECT p_partkey, substring(p_name, 2, 4) AS part_of, instr(p_name, 'i') AS found_at, lpad(p_brand, 12, '*') AS left_padded,
           rpad(p_brand, 12, '.') AS right_padded, trim('  ' || p_type || ' ') AS trimmed, ltrim('  ' || p_type || ' ') AS left_trimmed,
           rtrim(' ' || p_type || '  ') AS right_trimmed, upper(p_name) AS upper_case, lower(p_brand) AS lower_case,
           CAST(length(p_name) AS INT) AS size, replace(p_name, 'small', 'tiny') AS replaced, p_brand || '.' || p_name AS joined,
           p_type || chr(10) || p_brand AS two_lines, regexp_replace(p_brand, '[0-9]+', 'N', 'g') AS masked,
           split_part(p_name, ' ', 2) AS second_word FROM $part""")
def _(t):
    name, brand, kind = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    return t.part.select(
        "p_partkey", F.substring(name, 2, 4).alias("part_of"), F.instr(name, "i").cast("bigint").alias("found_at"),
        F.lpad(brand, 12, "*").alias("left_padded"), F.rpad(brand, 12, ".").alias("right_padded"),
        F.trim(F.concat(F.lit("  "), kind, F.lit(" "))).alias("trimmed"),
        F.ltrim(F.concat(F.lit("  "), kind, F.lit(" "))).alias("left_trimmed"),
        F.rtrim(F.concat(F.lit(" "), kind, F.lit("  "))).alias("right_trimmed"),
        F.upper(name).alias("upper_case"), F.lower(brand).alias("lower_case"), F.length(name).alias("size"),
        F.replace(name, F.lit("small"), F.lit("tiny")).alias("replaced"), F.concat_ws(".", brand, name).alias("joined"),
        F.concat(kind, F.char(F.lit(10)), brand).alias("two_lines"), F.regexp_replace(brand, "[0-9]+", "N").alias("masked"),
        F.split_part(name, F.lit(" "), F.lit(2)).alias("second_word"),
    )


@query("fn_regex", """
    SELECT event_id, regexp_extract(line, '([0-9]{4})-([0-9]{2})-([0-9]{2}) ([0-9]{2}):', 2) AS month,
           regexp_extract(line, 'node ([0-9]+)', 1) AS named, regexp_matches(line, 'leader: (new|this)') AS elects
    FROM (SELECT line_no AS event_id, line FROM $log_lines) l""")
def _(t):
    line = F.col("line")
    return t.log_lines.select(
        F.col("line_no").alias("event_id"),
        F.regexp_extract(line, r"(\d{4})-(\d{2})-(\d{2}) (\d{2}):", 2).alias("month"),
        F.regexp_extract(line, r"node (\d+)", 1).alias("named"), line.rlike("leader: (new|this)").alias("elects"),
    )


@query("fn_math", """
    SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity / 8, 1) AS rounded, CAST(floor(l_extendedprice / 7) AS BIGINT) AS floored,
           l_partkey % 60 AS remainder, CAST(ceil(l_extendedprice / 7) AS BIGINT) AS raised, CAST(trunc(l_extendedprice / 60) AS BIGINT) AS cut,
           power(l_linenumber, 3) AS cubed, greatest(l_partkey - l_suppkey, 1) AS at_least_one, (l_linenumber * 256) & 512 = 512 AS flagged
    FROM $lineitem""")
def _(t):
    price = F.col("l_extendedprice")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("l_quantity") / 8, 1).alias("rounded"),
        F.floor(price / 7).alias("floored"), (F.col("l_partkey") % 60).alias("remainder"), F.ceil(price / 7).alias("raised"),
        (price / 60).cast("bigint").alias("cut"), F.pow("l_linenumber", F.lit(3)).alias("cubed"),
        F.greatest(F.col("l_partkey") - F.col("l_suppkey"), F.lit(1)).alias("at_least_one"),
        ((F.col("l_linenumber") * 256).bitwiseAND(512) == 512).alias("flagged"),
    )


@query("fn_date", """
    SELECT event_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day, strftime(ts, '%d-%m-%y %H:%M:%S') AS shown, dayname(ts) AS weekday,
           CAST(date_diff('day', TIMESTAMP '2024-01-01', CAST(CAST(ts AS DATE) AS TIMESTAMP)) AS INT) AS days_in,
           ts + INTERVAL 90 MINUTE AS later, CAST(extract(hour FROM ts) AS INT) AS hour_of_day,
           CAST(epoch(strptime(strftime(ts, '%b %d %H:%M:%S %Y'), '%b %d %H:%M:%S %Y')) AS BIGINT) AS epoch_seconds,
           round((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 86400000000.0::DOUBLE, 4) AS age_days FROM $events""")
def _(t):
    ts = F.col("ts")
    start, end = F.lit("2024-01-01").cast("timestamp_ntz"), F.lit("2024-02-01").cast("timestamp_ntz")
    day = F.to_date(ts).cast("timestamp_ntz")
    text = F.date_format(ts, "MMM dd HH:mm:ss yyyy")
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))
    return t.events.select(
        "event_id", day.alias("day"), F.date_format(ts, "dd-MM-yy HH:mm:ss").alias("shown"), F.date_format(ts, "EEEE").alias("weekday"),
        F.expr("extract(DAY FROM date_trunc('DAY', ts) - TIMESTAMP '2024-01-01 00:00:00')").cast("int").alias("days_in"),
        (ts + F.expr("INTERVAL '90' MINUTE")).alias("later"), F.hour(ts).alias("hour_of_day"),
        F.unix_timestamp(F.to_timestamp(text, "MMM dd HH:mm:ss yyyy")).alias("epoch_seconds"),
        F.round(micros / F.lit(86400000000.0), 4).alias("age_days"),
    )


@query("fn_conditional", """
    SELECT sid, CASE WHEN last_call_et > 10800 THEN 'long' WHEN last_call_et > 3600 THEN 'medium' ELSE 'short' END AS length_class,
           CASE status WHEN 'ACTIVE' THEN 1 ELSE 0 END AS is_active, coalesce(username, '-') AS username,
           last_call_et / nullif(seconds_in_wait, 0) AS guarded FROM $sessions""")
def _(t):
    seconds = F.col("last_call_et")
    return t.sessions.select(
        "sid", F.when(seconds > 10800, "long").when(seconds > 3600, "medium").otherwise("short").alias("length_class"),
        F.expr("decode(status, 'ACTIVE', 1, 0)").alias("is_active"), F.coalesce("username", F.lit("-")).alias("username"),
        (seconds / F.nullif("seconds_in_wait", F.lit(0))).alias("guarded"),
    )


@query("fn_format", """
    SELECT o_orderkey, format('{:,}', cents // 100) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS price
    FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM $orders) o""")
def _(t):
    amount = F.col("o_totalprice").cast("decimal(12,2)")
    return t.orders.select("o_orderkey", F.trim(F.to_char(amount, F.lit("9,999,999,990.00"))).alias("price"))


@query("fn_convert", """
    SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS number, TRY_CAST(event_type AS BIGINT) AS not_a_number,
           CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM $events""")
def _(t):
    props = F.col("props")
    return t.events.select(
        "event_id", F.regexp_extract(props, r"(\d+)", 1).cast("double").alias("number"),
        F.col("event_type").try_cast("bigint").alias("not_a_number"), F.from_json(props, "k bigint")["k"].alias("k"),
    )
