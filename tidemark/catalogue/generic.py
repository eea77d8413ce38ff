"""Filters, joins, aggregates, windows, sorting and set operations on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalogue.registry import query
from tidemark.functions import exprs as X
from tidemark.operators import aggregates as A
from tidemark.operators import filters as P
from tidemark.operators import joins as J
from tidemark.operators import ranking as T
from tidemark.operators import sketches as K
from tidemark.operators.skew import lookup_join, semi_lookup, with_neighbour
from tidemark.session import written

# --- predicates and projections


@query("flt_range", """
    SELECT o_orderkey, o_totalprice FROM $orders
    WHERE o_totalprice >= 100000 AND o_totalprice < 300000 AND o_orderstatus <> 'P'""")
def _(t):
    price = F.col("o_totalprice")
    kept = t.orders.filter((price >= 100000) & (price < 300000) & (F.col("o_orderstatus") != "P"))
    return kept.select("o_orderkey", "o_totalprice")


@query("flt_exclusion_list", """
    SELECT o_orderpriority, count(*) AS n FROM $orders
    WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW') AND o_orderstatus IN ('F', 'O') GROUP BY 1""")
def _(t):
    kept = P.exclude_values(t.orders, "o_orderpriority", ["1-URGENT", "5-LOW"])
    return kept.filter(F.col("o_orderstatus").isin("F", "O")).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("flt_like", r"""
    SELECT owner, table_name FROM $tab_statistics
    WHERE table_name LIKE 'T%' AND NOT (table_name LIKE '%\_TEMP' ESCAPE '\' OR table_name LIKE '%\_TEMP\_%' ESCAPE '\')""")
def _(t):
    name = "table_name"
    temporary = F.expr(rf"{name} LIKE '%/_TEMP' ESCAPE '/' OR {name} LIKE '%/_TEMP/_%' ESCAPE '/'")
    return t.tab_statistics.filter(F.col(name).like("T%") & ~temporary).select("owner", name)


@query("flt_regex", """
    SELECT nspname, count(*) AS n FROM $pg_namespace WHERE NOT regexp_matches(nspname, '^pg_toast') GROUP BY 1""")
def _(t):
    return t.pg_namespace.filter(~F.col("nspname").rlike("^pg_toast")).groupBy("nspname").agg(F.count("*").alias("n"))


@query("flt_null", """
    SELECT sid, coalesce(username, '(none)') AS username, coalesce(blocking_session, -1) AS blocker FROM $sessions
    WHERE username IS NULL OR blocking_session IS NOT NULL""")
def _(t):
    kept = t.sessions.filter(F.col("username").isNull() | F.col("blocking_session").isNotNull())
    return kept.select(
        "sid", F.coalesce("username", F.lit("(none)")).alias("username"),
        F.coalesce("blocking_session", F.lit(-1)).alias("blocker"),
    )


@query("flt_trailing_window", """
    SELECT event_id, ts FROM $events
    WHERE ts BETWEEN TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 2 HOUR AND TIMESTAMP '2024-01-20 12:00:00'""")
def _(t):
    return t.events.filter(
        P.trailing_window(F.col("ts"), P.as_ntz("2024-01-20 12:00:00"), 7200)
    ).select("event_id", "ts")


@query("flt_same_day", """
    SELECT event_type, count(*) AS n FROM $events
    WHERE date_trunc('day', ts) = TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1""")
def _(t):
    day = t.events.filter(P.same_day(F.col("ts"), "2024-01-20 12:00:00"))
    return day.groupBy("event_type").agg(F.count("*").alias("n"))


@query("flt_tuple_in", """
    SELECT lock_no, sid FROM $locks l WHERE EXISTS (SELECT 1 FROM $locks w
        WHERE w.request > 0 AND w.id1 = l.id1 AND w.id2 = l.id2 AND w.lock_type = l.lock_type)""")
def _(t):
    locks = t.locks
    return semi_lookup(locks, locks.filter("request > 0"), ["id1", "id2", "lock_type"]).select("lock_no", "sid")


@query("flt_not_exists", """
    SELECT c_custkey FROM $customer WHERE NOT EXISTS
        (SELECT 1 FROM $orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""")
def _(t):
    done = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(done, "c_custkey", "left_anti").select("c_custkey")


@query("flt_dynamic_like", """
    SELECT inst_id, sid FROM $sessions WHERE program LIKE 'B%' AND event LIKE '%contention%'""")
def _(t):
    chosen = P.like_filters(t.sessions, {"program": "B%", "event": "%contention%", "module": ""})
    return chosen.select("inst_id", "sid")


@query("flt_instances", "SELECT inst_id, count(*) AS n FROM $sessions WHERE inst_id IN (1, 3) GROUP BY 1")
def _(t):
    names = {"db1": 1, "db2": 2, "db3": 3}
    return P.choose_instances(t.sessions, names, ["DB1", "db3"]).groupBy("inst_id").agg(F.count("*").alias("n"))


@query("prj_decode_labels", """
    SELECT lock_no, CASE is_blocking WHEN 0 THEN 'Waiting' ELSE 'Blocking' END AS user_status,
           CASE lmode WHEN 0 THEN 'None' WHEN 3 THEN 'Row Excl.' WHEN 6 THEN 'Exclusive' ELSE 'Other' END AS mode
    FROM $locks""")
def _(t):
    return t.locks.select(
        "lock_no",
        X.decode(F.col("is_blocking"), {0: "Waiting"}, "Blocking").alias("user_status"),
        X.decode(F.col("lmode"), {0: "None", 3: "Row Excl.", 6: "Exclusive"}, "Other").alias("mode"),
    )


@query("prj_narrative", """
    SELECT sid, coalesce(username, '') || '@' || machine || ' ( SID=' || sid || ' )' AS who FROM $sessions""")
def _(t):
    who = F.concat(F.coalesce("username", F.lit("")), F.lit("@"), "machine", F.lit(" ( SID="), "sid", F.lit(" )"))
    return t.sessions.select("sid", who.alias("who"))


# --- joins


@query("join_multi_equi", """
    SELECT n_name, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
    FROM $lineitem JOIN $orders ON l_orderkey = o_orderkey JOIN $customer ON o_custkey = c_custkey
         JOIN $nation ON c_nationkey = n_nationkey JOIN $region ON n_regionkey = r_regionkey
    WHERE o_orderstatus = 'F' GROUP BY n_name""")
def _(t):
    money = F.sum(F.col("l_extendedprice").cast("decimal(18,2)"))
    joined = (
        t.lineitem.select("l_orderkey", "l_extendedprice")
        .join(t.orders.filter("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return joined.groupBy("n_name").agg(F.count("*").alias("n"), money.cast("double").alias("revenue"))


@query("join_left", """
    SELECT c_custkey, count(o_orderkey) AS n FROM $customer LEFT JOIN $orders ON o_custkey = c_custkey GROUP BY 1""")
def _(t):
    per_customer = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("n"))
    return t.customer.select("c_custkey").join(per_customer, "c_custkey", "left").na.fill(0, ["n"])


@query("join_left_prefiltered", """
    SELECT c_custkey, o.o_orderkey FROM $customer LEFT JOIN
        (SELECT * FROM $orders WHERE o_orderstatus = 'P' AND o_totalprice > 400000) o ON o_custkey = c_custkey""")
def _(t):
    orders = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    keep = (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 400000)
    return J.left_prefiltered(t.customer, orders, ["c_custkey"], keep).select("c_custkey", "o_orderkey")


@query("join_left_chain", """
    SELECT count(*) AS n, count(o_custkey) AS with_orders, count(s_nationkey) AS with_suppliers
    FROM $customer LEFT JOIN (SELECT DISTINCT o_custkey FROM $orders WHERE o_orderstatus = 'P') o ON o_custkey = c_custkey
         LEFT JOIN (SELECT DISTINCT s_nationkey FROM $supplier WHERE s_acctbal > 9000) s ON s_nationkey = c_nationkey""")
def _(t):
    orders = t.orders.filter("o_orderstatus = 'P'").select("o_custkey").distinct()
    rich = t.supplier.filter("s_acctbal > 9000").select("s_nationkey").distinct()
    chained = t.customer.join(orders, F.col("o_custkey") == F.col("c_custkey"), "left").join(
        rich, F.col("s_nationkey") == F.col("c_nationkey"), "left"
    )
    return chained.agg(
        F.count("*").alias("n"), F.count("o_custkey").alias("with_orders"),
        F.count("s_nationkey").alias("with_suppliers"),
    )


@query("join_scalar_cross", """
    SELECT (SELECT count(*) FROM $orders) AS orders, (SELECT max(l_linenumber) FROM $lineitem) AS lines,
           count(*) AS customers FROM $customer""")
def _(t):
    orders = t.orders.select(F.count("*")).scalar()
    lines = t.lineitem.select(F.max("l_linenumber")).scalar()
    facts = t.customer.agg(F.count("*").alias("customers"))
    return facts.select(orders.alias("orders"), lines.alias("lines"), "customers")


@query("join_self_blocking", """
    SELECT w.sid AS waiter, b.sid AS blocker, b.status AS blocker_status
    FROM $sessions w JOIN $sessions b ON w.blocking_session = b.sid AND w.blocking_instance = b.inst_id""")
def _(t):
    waiters = t.sessions.filter("blocking_session IS NOT NULL").select(
        F.col("sid").alias("waiter"), F.col("blocking_session").alias("blocker"),
        F.col("blocking_instance").alias("inst_id"),
    )
    blockers = t.sessions.select(F.col("sid").alias("blocker"), "inst_id", F.col("status").alias("blocker_status"))
    return lookup_join(waiters, blockers, ["blocker", "inst_id"], "inner").drop("inst_id")


@query("join_semi", """
    SELECT p_partkey FROM $part WHERE p_partkey IN
        (SELECT l_partkey FROM $lineitem WHERE l_discount > 0.09 AND l_quantity > 48)""")
def _(t):
    picked = t.lineitem.filter("l_discount > 0.09 AND l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"))
    return t.part.join(picked, "p_partkey", "left_semi").select("p_partkey")


@query("join_anti", """
    SELECT sid FROM $sessions s WHERE blocking_session IS NULL AND sid NOT IN
        (SELECT blocking_session FROM $sessions WHERE blocking_session IS NOT NULL)""")
def _(t):
    blockers = t.sessions.select(F.col("blocking_session").alias("sid")).dropna()
    return t.sessions.filter("blocking_session IS NULL").join(blockers, "sid", "left_anti").select("sid")


@query("join_scalar_subquery", """
    SELECT c_custkey, (SELECT count(*) FROM $orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS n
    FROM $customer""")
def _(t):
    counts = (
        t.orders.filter("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    )
    return t.customer.select("c_custkey").join(counts, "c_custkey", "left").na.fill(0, ["n"])


@query("join_any_one", """
    SELECT p_brand, n, any_name FROM (SELECT p_brand, count(*) AS n, min(p_name) AS any_name FROM $part GROUP BY 1) p""")
def _(t):
    counts = t.part.groupBy("p_brand").agg(F.count("*").alias("n"))
    names = J.any_one(t.part, ["p_brand"], "p_name").withColumnRenamed("p_name", "any_name")
    return counts.join(names, "p_brand", "left")


@query("join_normalised_key", """
    SELECT m.host, u.sid, m.n FROM
        (SELECT lower(split_part(entity_name, '.', 1)) AS host, count(*) AS n FROM $metric_values GROUP BY 1) m
        JOIN (SELECT sid, 'HOST' || sid AS name FROM $sessions) u ON lower(u.name) = m.host""")
def _(t):
    samples = t.metric_values.groupBy(X.host_key(F.col("entity_name")).alias("host")).agg(F.count("*").alias("n"))
    named = t.sessions.select("sid", X.host_key(F.concat(F.lit("HOST"), "sid")).alias("host"))
    return samples.join(named, "host")


@query("join_longest_prefix", """
    SELECT page_id, mount FROM (
        SELECT page_id, mount, row_number() OVER (PARTITION BY page_id ORDER BY length(mount) DESC) AS rn
        FROM $mounted_paths p JOIN $mounts m ON p.target = m.target
             AND (p.path = m.mount OR starts_with(p.path, m.mount || '/'))) x WHERE rn = 1""")
def _(t):
    found = J.longest_prefix(t.mounted_paths, t.mounts, ["page_id"], "path", "mount", ["target"])
    return found.select("page_id", "mount")


LIMITS = """
    SELECT 'host' || c_custkey AS entity_name, 'key' || (c_custkey % 4) AS metric_key_value,
           '30' AS warning, '60.5' AS critical FROM $customer
    UNION ALL SELECT 'host' || c_custkey, ' ', '50', '90' FROM $customer WHERE c_acctbal > 2000"""


@query("join_threshold_fallback", f"""
    SELECT m.event_id, coalesce(s.warning, d.warning) AS warning, coalesce(s.critical, d.critical) AS critical
    FROM $metric_values m
    LEFT JOIN (SELECT entity_name, metric_key_value, CAST(warning AS DOUBLE) AS warning,
                      CAST(critical AS DOUBLE) AS critical FROM ({LIMITS}) a WHERE trim(metric_key_value) <> '') s
      ON split_part(m.entity_name, '.', 1) = s.entity_name AND m.metric_key_value = s.metric_key_value
    LEFT JOIN (SELECT entity_name, CAST(warning AS DOUBLE) AS warning, CAST(critical AS DOUBLE) AS critical
               FROM ({LIMITS}) a WHERE trim(metric_key_value) = '') d
      ON split_part(m.entity_name, '.', 1) = d.entity_name""")
def _(t):
    own = t.customer.select(
        F.concat(F.lit("host"), "c_custkey").alias("entity_name"),
        F.concat(F.lit("key"), F.col("c_custkey") % 4).alias("metric_key_value"),
        F.lit("30").alias("warning"), F.lit("60.5").alias("critical"),
    )
    default = t.customer.filter("c_acctbal > 2000").select(
        F.concat(F.lit("host"), "c_custkey").alias("entity_name"), F.lit(" ").alias("metric_key_value"),
        F.lit("50").alias("warning"), F.lit("90").alias("critical"),
    )
    facts = t.metric_values.withColumn("entity_name", X.host_short(F.col("entity_name")))
    out = J.threshold_fallback(
        facts, own.unionByName(default), "entity_name", "metric_key_value", ["warning", "critical"]
    )
    return out.select("event_id", "warning", "critical")


@query("join_prev_snapshot", """
    SELECT n.inst_id, n.name, n.total_waits - p.total_waits AS waits FROM $counter_snapshots n
    JOIN $counter_snapshots p ON p.inst_id = n.inst_id AND p.name = n.name
    WHERE n.snap_id = (SELECT max(snap_id) FROM $counter_snapshots)
      AND p.snap_id = (SELECT max(snap_id) FROM $counter_snapshots
                       WHERE snap_id < (SELECT max(snap_id) FROM $counter_snapshots))""")
def _(t):
    snaps = t.counter_snapshots
    ids = snaps.select("snap_id").distinct().orderBy(F.col("snap_id").desc()).limit(2)
    two = snaps.join(ids, "snap_id", "left_semi")
    both = two.groupBy("inst_id", "name").agg(
        F.max_by("total_waits", "snap_id").alias("newest"), F.min_by("total_waits", "snap_id").alias("previous"),
        F.count("*").alias("n"),
    )
    return both.filter("n = 2").select("inst_id", "name", (F.col("newest") - F.col("previous")).alias("waits"))


@query("join_broadcast_dim", """
    SELECT r_name, count(*) AS n FROM $customer JOIN $nation ON n_nationkey = c_nationkey
    JOIN $region ON r_regionkey = n_regionkey GROUP BY 1""")
def _(t):
    # Catalyst broadcasts the two small sides by their measured size.
    dims = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    joined = t.customer.join(dims, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("r_name").agg(F.count("*").alias("n"))


@query("join_full_reconcile", """
    SELECT coalesce(a.host_name, b.host_name) AS host_name, a.host_name IS NOT NULL AS in_left,
           b.host_name IS NOT NULL AS in_right
    FROM (SELECT DISTINCT host_name FROM $components) a FULL JOIN (SELECT DISTINCT host_name FROM $components_other) b
      ON a.host_name = b.host_name""")
def _(t):
    return J.full_reconcile(t.components, t.components_other, ["host_name"])


@query("join_prev_line", """
    SELECT node, file, line_no, lag(line) OVER (PARTITION BY node, file ORDER BY line_no) AS previous_line
    FROM $log_lines""")
def _(t):
    return J.previous_line(t.log_lines, 500).select("node", "file", "line_no", "previous_line")


# --- aggregation


@query("agg_global", """
    SELECT count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total,
           min(o_orderdate) AS first_day, max(o_orderdate) AS last_day FROM $orders""")
def _(t):
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    return t.orders.agg(
        F.count("*").alias("n"), total.alias("total"), F.min("o_orderdate").alias("first_day"),
        F.max("o_orderdate").alias("last_day"),
    )


@query("agg_group_stats", """
    SELECT event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total,
           round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*), 6) AS mean,
           min(value) AS low, max(value) AS high FROM $events GROUP BY 1""")
def _(t):
    total = F.sum(F.col("value").cast("decimal(18,2)")).cast("double")
    return t.events.groupBy("event_type").agg(
        F.count("*").alias("n"), total.alias("total"), F.round(total / F.count("*"), 6).alias("mean"),
        F.min("value").alias("low"), F.max("value").alias("high"),
    )


@query("agg_sketch_rollup", """
    SELECT event_type, count(*) AS rows, true AS distinct_holds, true AS median_holds, true AS p95_holds FROM $events
    WHERE extract(day FROM ts) BETWEEN 3 AND 21 GROUP BY 1""")
def _(t):
    """Nineteen days merged from daily sketches, and whether they keep their stated errors against the rows themselves."""
    days = F.dayofmonth("ts")
    kept = written(K.daily_sketches(t.events, days, ["event_type"], "user_id", "value"), "sketches")
    merged = K.rolled_up(kept, ["event_type"], F.lit(3), F.lit(21))
    near = merged.select("event_type", F.col("rows"), F.col("distinct"), "p50", "p95")
    rows = t.events.filter(days.between(3, 21)).join(F.broadcast(near.select("event_type", "p50", "p95")), "event_type")
    exact = rows.groupBy("event_type").agg(
        F.count_distinct("user_id").alias("exact"), *[
            F.avg((F.col("value") <= F.col(p)).cast("double")).alias(f"{p}_to") for p in ("p50", "p95")
        ], *[F.avg((F.col("value") < F.col(p)).cast("double")).alias(f"{p}_from") for p in ("p50", "p95")]
    )
    joined = near.join(exact, "event_type")
    holds = lambda p, share: (F.col(f"{p}_from") <= share + K.RANK_ERROR) & (F.col(f"{p}_to") >= share - K.RANK_ERROR)
    return joined.select(
        "event_type", "rows", (F.abs(F.col("distinct") - F.col("exact")) <= 4 * K.DISTINCT_ERROR * F.col("exact") + 1).alias("distinct_holds"),
        holds("p50", 0.5).alias("median_holds"), holds("p95", 0.95).alias("p95_holds"),
    )


@query("agg_count_distinct", """
    SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers
    FROM $lineitem GROUP BY 1""")
def _(t):
    counts = A.distinct_counts(t.lineitem, ["l_returnflag"], ["l_partkey", "l_suppkey"])
    return counts.withColumnsRenamed({"l_partkey": "parts", "l_suppkey": "suppliers"})


@query("agg_having", "SELECT o_custkey, count(*) AS n FROM $orders GROUP BY 1 HAVING count(*) > 15")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n > 15")


HOURS = ", ".join(
    f"sum(CASE WHEN extract(hour FROM first_time) = {h} THEN 1 ELSE 0 END)::BIGINT AS h{h:02d}" for h in range(24)
)


@query("agg_pivot_hours", f"""
    SELECT thread_no, strftime(first_time, '%Y-%m-%d') AS log_date, {HOURS}, count(*) AS total
    FROM $archived_log GROUP BY 1, 2""")
def _(t):
    return A.hourly_volume(t.archived_log, ["thread_no"], "first_time")


@query("agg_pct_of_total", """
    SELECT l_suppkey, total, round(total * 100 / sum(total) OVER (), 2) AS pct FROM (
        SELECT l_suppkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total
        FROM $lineitem GROUP BY 1) s""")
def _(t):
    sums = t.lineitem.groupBy("l_suppkey").agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("total")
    )
    return A.percent_of_total(sums, "total").withColumn("total", F.col("total").cast("double"))


@query("agg_rollup_total", """
    SELECT owner, segment_type, sum(bytes)::BIGINT AS bytes, CAST(grouping_id(owner, segment_type) AS INT) AS total_level
    FROM $segments GROUP BY ROLLUP (owner, segment_type)""")
def _(t):
    return A.with_totals(t.segments, ["owner", "segment_type"], ["bytes"])


@query("agg_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM $orders")
def _(t):
    return t.orders.select("o_orderstatus", "o_orderpriority").distinct()


# A mean with one decimal, halves up, in whole numbers: exact where a division of doubles is not.
MEAN = "((2 * sum(CAST(round(value * 100) AS BIGINT)) + 10 * count(*)) // (20 * count(*)))::DOUBLE / 10"


@query("agg_nested", f"""
    SELECT user_id, max(mean) AS worst FROM (SELECT user_id, event_type, {MEAN} AS mean FROM $events GROUP BY 1, 2) m GROUP BY 1""")
def _(t):
    # Divided as decimals, so that a mean halfway between two steps rounds up.
    mean = F.round(F.sum(F.col("value").cast("decimal(18,2)")) / F.count("*"), 1).cast("double")
    means = t.events.groupBy("user_id", "event_type").agg(mean.alias("mean"))
    return means.groupBy("user_id").agg(F.max("mean").alias("worst"))


@query("agg_worst_age", """
    SELECT CAST(max(round(epoch(TIMESTAMP '2001-09-01 00:00:00' - newest) / 86400.0, 0)) AS BIGINT) AS worst_days
    FROM (SELECT l_partkey, max(l_shipdate) AS newest FROM $lineitem GROUP BY 1) n""")
def _(t):
    return A.worst_age(t.lineitem, ["l_partkey"], "l_shipdate", P.as_ntz("2001-09-01 00:00:00"))


@query("agg_latest", """
    SELECT user_id, event_id, event_type, value FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM $events) e
    WHERE rn = 1""")
def _(t):
    events = t.events.select("user_id", "event_id", "event_type", "value", "ts")
    return T.latest_row(events, ["user_id"], ["ts", "event_id"]).drop("ts")


@query("agg_concat", """
    SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS members
    FROM (SELECT DISTINCT user_id, event_type FROM $events) e GROUP BY 1""")
def _(t):
    # Five event types exist, so no list is longer.
    return A.member_list(t.events, ["user_id"], "event_type")


# --- windows


@query("win_latest_row", """
    SELECT entity_name, metric_key_value, event_id, value FROM (
        SELECT *, row_number() OVER (PARTITION BY entity_name, metric_key_value
                                     ORDER BY collection_time DESC, event_id DESC) AS rn FROM $metric_values) m
    WHERE rn = 1""")
def _(t):
    keys = ["entity_name", "metric_key_value"]
    samples = t.metric_values.select(*keys, "collection_time", "event_id", "value")
    return T.latest_row(samples, keys, ["collection_time", "event_id"]).drop("collection_time")


TOP_OF_GROUP = """
    SELECT entity_name, metric_key_value, n FROM (
        SELECT *, row_number() OVER (PARTITION BY entity_name ORDER BY n DESC, metric_key_value) AS rn FROM (
            SELECT entity_name, metric_key_value, count(*) AS n FROM $metric_values GROUP BY 1, 2) c) r
    WHERE rn <= {n}"""


def top_keys(t, n):
    counts = t.metric_values.groupBy("entity_name", "metric_key_value").agg(F.count("*").alias("n"))
    order = [F.col("n").desc(), F.col("metric_key_value")]
    return T.top_n_per_group(counts, ["entity_name"], order, n).drop("rn")


@query("win_top1_group", TOP_OF_GROUP.format(n=1))
def _(t):
    return top_keys(t, 1)


@query("topn_per_group", TOP_OF_GROUP.format(n=3))
def _(t):
    return top_keys(t, 3)


@query("win_longest", """
    SELECT p_brand, p_name, p_partkey FROM (
        SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY length(p_name) DESC, p_partkey) AS rn FROM $part) p
    WHERE rn = 1""")
def _(t):
    parts = t.part.select("p_brand", "p_name", "p_partkey")
    return T.top_n_per_group(parts, ["p_brand"], [F.length("p_name").desc(), F.col("p_partkey")], 1).drop("rn")


@query("win_rank_topk", """
    SELECT o_orderkey, o_totalprice, CAST(rnk AS INT) AS rnk FROM (
        SELECT *, rank() OVER (ORDER BY o_totalprice DESC) AS rnk FROM $orders) o WHERE rnk <= 10""")
def _(t):
    orders = t.orders.select("o_orderkey", "o_totalprice")
    return T.rank_top(orders, F.col("o_totalprice"), 10, "rnk")


@query("win_rank_over_agg", """
    SELECT l_partkey, n, CAST(rnk AS INT) AS rnk FROM (
        SELECT l_partkey, n, rank() OVER (ORDER BY n DESC NULLS LAST) AS rnk FROM (
            SELECT l_partkey, count(*) AS n FROM $lineitem GROUP BY 1) c) r WHERE rnk <= 20""")
def _(t):
    counts = t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n"))
    return T.rank_top(counts, F.col("n"), 20, "rnk")


@query("win_lead_pairs", """
    SELECT * FROM (SELECT instance_number, snap_id AS begin_snap, lead(snap_id) OVER
        (PARTITION BY instance_number ORDER BY snap_id) AS end_snap FROM $snapshots) s WHERE end_snap IS NOT NULL""")
def _(t):
    chunk = F.floor(F.col("snap_id") / 1000)
    paired = with_neighbour(t.snapshots, ["instance_number"], ["snap_id"], ["snap_id"], chunk, following=True, name="n")
    return paired.filter("n IS NOT NULL").select(
        "instance_number", F.col("snap_id").alias("begin_snap"), F.col("n.snap_id").alias("end_snap")
    )


@query("win_rownum", """
    SELECT CAST(row_number() OVER (ORDER BY n DESC, o_custkey) AS INT) AS rank, o_custkey, n FROM (
        SELECT o_custkey, count(*) AS n FROM $orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 10) o""")
def _(t):
    counts = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return T.top_n(counts, [F.col("n").desc(), F.col("o_custkey")], 10, "rank")


# --- sorting, limits, sets


@query("sort_multi", "SELECT p_partkey, p_brand, p_size FROM $part ORDER BY p_brand, p_size DESC, p_partkey")
def _(t):
    return t.part.select("p_partkey", "p_brand", "p_size").orderBy("p_brand", F.col("p_size").desc(), "p_partkey")


@query("topn", "SELECT l_orderkey, l_partkey, l_extendedprice FROM $lineitem ORDER BY 3 DESC, 1, 2 LIMIT 10")
def _(t):
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_extendedprice")
    return T.top_n(lines, [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_partkey")], 10)


@query("topn_then_asc", """
    SELECT * FROM (SELECT sid, last_call_et FROM $sessions ORDER BY last_call_et DESC, sid LIMIT 10) s
    ORDER BY last_call_et, sid DESC""")
def _(t):
    return T.top_n_shown_ascending(t.sessions.select("sid", "last_call_et"), "last_call_et", ["sid"], 10)


@query("set_union_all", """
    SELECT 'customers' AS item, CAST(count(*) AS VARCHAR) AS item_value FROM $customer
    UNION ALL SELECT 'orders', CAST(count(*) AS VARCHAR) FROM $orders
    UNION ALL SELECT 'newest order', strftime(max(o_orderdate), '%Y-%m-%d') FROM $orders""")
def _(t):
    def fact(name, df, value):
        return df.agg(value.cast("string").alias("item_value")).select(F.lit(name).alias("item"), "item_value")

    newest = F.date_format(F.max("o_orderdate"), "yyyy-MM-dd")
    return (
        fact("customers", t.customer, F.count("*"))
        .unionByName(fact("orders", t.orders, F.count("*")))
        .unionByName(fact("newest order", t.orders, newest))
    )


@query("set_union", """
    SELECT c_nationkey AS nationkey FROM $customer WHERE c_acctbal > 9000
    UNION SELECT s_nationkey FROM $supplier""")
def _(t):
    a = t.customer.filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("nationkey"))
    return a.union(t.supplier.select("s_nationkey")).distinct()


@query("set_symmetric_diff", """
    SELECT type, host_name, CASE WHEN n = 1 THEN 'right' ELSE 'left' END AS missing_in FROM (
        SELECT type, host_name, sum(side) AS n FROM (
            SELECT DISTINCT type, host_name, 1 AS side FROM $components
            UNION ALL SELECT DISTINCT type, host_name, 2 FROM $components_other) u GROUP BY 1, 2) g WHERE n < 3""")
def _(t):
    return J.symmetric_difference(t.components, t.components_other, ["type", "host_name"])


@query("set_unique", "SELECT DISTINCT l_partkey, l_suppkey FROM $lineitem")
def _(t):
    return t.lineitem.select("l_partkey", "l_suppkey").dropDuplicates()


@query("set_unique_in_order", """
    SELECT l_suppkey, min(l_orderkey * 10 + l_linenumber) AS first_place FROM $lineitem GROUP BY 1""")
def _(t):
    lines = t.lineitem.withColumn("place", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return J.unique_in_order(lines, ["l_suppkey"], "place", "first_place")


@query("flt_exclusion_long", """
    SELECT count(*) AS n FROM $lineitem WHERE l_suppkey > 150 OR l_suppkey < 1""")
def _(t):
    return P.exclude_values(t.lineitem, "l_suppkey", list(range(1, 151))).agg(F.count("*").alias("n"))


@query("flt_exclusion_null", """
    SELECT count(*) AS n FROM $orders WHERE o_orderpriority NOT IN ('1-URGENT', NULL)""")
def _(t):
    return P.exclude_values(t.orders, "o_orderpriority", ["1-URGENT", None]).agg(F.count("*").alias("n"))


@query("join_residual", """
    SELECT a.l_orderkey, a.l_linenumber AS line, b.l_linenumber AS other FROM $lineitem a JOIN $lineitem b
    ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey AND a.l_linenumber < b.l_linenumber""")
def _(t):
    lines = t.lineitem.select("l_orderkey", "l_suppkey", F.col("l_linenumber").alias("line"))
    others = lines.withColumnRenamed("line", "other")
    return lines.join(others, ["l_orderkey", "l_suppkey"]).filter("line < other").select("l_orderkey", "line", "other")


@query("join_null_safe_keys", """
    SELECT l.pid, l.locktype, l.relation, l.transactionid, c.n FROM $pg_locks l JOIN (
        SELECT locktype, relation, transactionid, count(*) AS n FROM $pg_locks GROUP BY 1, 2, 3) c
    ON l.locktype IS NOT DISTINCT FROM c.locktype AND l.relation IS NOT DISTINCT FROM c.relation
       AND l.transactionid IS NOT DISTINCT FROM c.transactionid""")
def _(t):
    keys = ["locktype", "relation", "transactionid"]
    counts = t.pg_locks.groupBy(*keys).agg(F.count("*").alias("n"))
    return J.null_safe_join(t.pg_locks.select("pid", *keys), counts, keys).select("pid", *keys, "n")
