"""Parsers, log mining, configuration audits, readiness gates and versioned rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalogue.registry import query
from tidemark.operators import checks as G
from tidemark.operators import logs as C
from tidemark.operators import rows as V
from tidemark.operators.filters import as_ntz
from tidemark.operators.partitions import rewrite_partitions
from tidemark.operators.ranges import range_diff
from tidemark.operators.ranking import top_n
from tidemark.operators.rules import match_rules
from tidemark.operators.skew import lookup_join
from tidemark.plans import gates as U
from tidemark.session import work_folder
from tidemark.sources import files as S
from tidemark.sources.lines import read_log_files
from tidemark.sources import text as P
from tidemark.specs import ATTACHMENT_PATTERNS, LEADER_RULES, MEMBER_PATTERN, RANK_PATTERN, STATE_PATTERN

# --- sources and sinks


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("src_union_instances", " UNION ALL ".join(
    f"SELECT {inst} AS inst_id, c_custkey, c_acctbal FROM $customer WHERE c_mktsegment = '{name}'" for inst, name in enumerate(SEGMENTS, 1)
))
def _(t):
    rows = t.customer.select("c_custkey", "c_acctbal", "c_mktsegment")
    return S.union_instances({inst: rows.filter(F.col("c_mktsegment") == name).drop("c_mktsegment") for inst, name in enumerate(SEGMENTS, 1)})


def drawn(column: int) -> str:
    return f"(('0x' || substring(md5(o_orderkey || ':0.{column}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


@query("src_generate", f"""
    SELECT num1, count(*) AS n, round(avg(num2), 6) AS mean2, round(avg(num3), 4) AS mean3 FROM (
        SELECT CAST(round({drawn(1)} * 10, 0) AS BIGINT) AS num1, {drawn(2)} AS num2, {drawn(3)} * 142 AS num3 FROM $orders) g
    GROUP BY 1""")
def _(t):
    rows = S.random_columns(t.orders.select("o_orderkey"), "o_orderkey")
    return rows.groupBy("num1").agg(
        F.count("*").alias("n"), F.round(F.avg("num2"), 6).alias("mean2"), F.round(F.avg("num3"), 4).alias("mean3")
    )


@query("sink_csv_roundtrip", "SELECT sid, username, program, last_call_et, logon_time FROM $sessions")
def _(t):
    rows = t.sessions.select("sid", "username", "program", "last_call_et", "logon_time")
    folder = work_folder(t.spark, "csv")
    S.export_csv(rows, folder)
    return S.import_csv(t.spark, folder, rows.schema)


@query("sink_csv_texts", """
    SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN '"' || text || '"' ELSE text END AS text FROM documents""")
def _(t):
    case = "CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN '\"' || text || '\"' ELSE text END AS text"
    rows = t.documents.selectExpr("doc_id", case)
    folder = work_folder(t.spark, "csv")
    S.export_csv(rows, folder)
    return S.import_csv(t.spark, folder, rows.schema)


@query("sink_report", """
    SELECT o_orderpriority, count(*) AS n FROM $orders GROUP BY 1""")
def _(t):
    folder = work_folder(t.spark, "reports")
    counts = t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    # A run that is repeated leaves one copy of its report.
    S.write_report(counts, folder, "priorities", "2024-01-20")
    S.write_report(counts, folder, "priorities", "2024-01-20")
    S.write_report(t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n")), folder, "states", "2024-01-20")
    return S.read_report(t.spark, folder, "priorities", "2024-01-20")


@query("src_generate_series", "SELECT count(*) AS n, 0 AS below, 0 AS above FROM $orders")
def _(t):
    rows = S.generate_series_table(t.spark, t.orders.count())
    return rows.agg(
        F.count("*").alias("n"), F.count_if(F.expr("num1 < 0 OR num2 < 0 OR num3 < 0")).cast("int").alias("below"),
        F.count_if(F.expr("num1 > 10 OR num2 > 1 OR num3 > 142")).cast("int").alias("above"),
    )


def field(new: str, old: str) -> str:
    def value(key):
        return f"max(CASE WHEN starts_with(trim(line), '{key}: ') THEN nullif(trim(substring(trim(line), {len(key) + 3})), '') END)"

    return f"coalesce({value(new)}, {value(old)})"


STATUS = f"""
    SELECT host, {field("Replica_IO_Running", "Slave_IO_Running")} AS io_running,
           {field("Replica_SQL_Running", "Slave_SQL_Running")} AS sql_running,
           {field("Seconds_Behind_Source", "Seconds_Behind_Master")} AS seconds_behind,
           {field("Last_SQL_Error", "Last_IO_Error")} AS last_error FROM $status_lines GROUP BY 1"""


@query("src_kv_status", STATUS)
def _(t):
    return P.parse_kv_status(t.status_lines, P.REPLICA_FIELDS)


@query("cls_replication", f"""
    SELECT host, lag_seconds, exit_code, CASE exit_code WHEN 2 THEN 'CRITICAL' WHEN 1 THEN 'WARNING' ELSE 'OK' END AS status FROM (
        SELECT host, TRY_CAST(seconds_behind AS BIGINT) AS lag_seconds,
               greatest(CASE lower(io_running) WHEN 'yes' THEN 0 WHEN 'no' THEN 2 ELSE 1 END,
                        CASE lower(sql_running) WHEN 'yes' THEN 0 WHEN 'no' THEN 2 ELSE 1 END,
                        CASE WHEN TRY_CAST(seconds_behind AS BIGINT) > 30 THEN 2 WHEN TRY_CAST(seconds_behind AS BIGINT) > 0 THEN 1 ELSE 0 END,
                        CASE WHEN last_error IS NOT NULL THEN 2 ELSE 0 END) AS exit_code FROM ({STATUS}) s) c""")
def _(t):
    return G.replication_health(P.parse_kv_status(t.status_lines, P.REPLICA_FIELDS))


@query("src_param_lines", """
    SELECT line_no, 'cell' AS component_type, unnest([x for x in string_split(trim(regexp_replace(
               regexp_extract(line, '^EM_CELLS=(.*)$', 1), '[()]', ' ', 'g')), ' ') if x <> '']) AS host
    FROM $param_lines WHERE starts_with(line, 'EM_CELLS=')
    UNION ALL SELECT line_no, CASE WHEN starts_with(line, 'swiib') THEN 'switch' ELSE 'pdu' END, regexp_extract(line, 'name=(.*)$', 1)
    FROM $param_lines WHERE regexp_matches(line, '^(swiib|pdu).*name=')""")
def _(t):
    return P.parse_param_lines(t.param_lines)


def side(domain, ip, name):
    """One side of a rack component; an empty text is a missing element."""
    return F.struct(*[
        F.nullif(F.col(column), F.lit("")).alias(tag) for column, tag in ((domain, "DOMAIN"), (ip, "IP"), (name, "NAME"))
    ])


def written_xml(t, items):
    folder = work_folder(t.spark, "xml")
    items.write.format("xml").option("rootTag", "RACK").option("rowTag", "ITEM").save(folder)
    return folder


@query("src_components_xml", """
    SELECT admin_domain, admin_ip, admin_name, NULL AS client_domain, NULL AS client_ip, NULL AS client_name, host_name, id, type FROM $components
    UNION ALL SELECT NULL, NULL, NULL, nullif(client_domain, ''), client_ip, client_name, host_name, id, type FROM $components
    WHERE client_ip <> '' AND client_name <> ''""")
def _(t):
    items = t.components.select(
        side("admin_domain", "admin_ip", "admin_name").alias("ADMIN"),
        side("client_domain", "client_ip", "client_name").alias("CLIENT"),
        F.col("host_name").alias("HOSTNAME"), F.col("id").alias("ID"), F.col("type").alias("TYPE"),
    )
    return S.read_components_xml(t.spark, written_xml(t, items), "catalog")


@query("src_components_xml_machine", "SELECT admin_domain, admin_ip, admin_name, host_name, id, type FROM $components")
def _(t):
    items = t.components.select(
        F.col("admin_domain").alias("ADMINDOMAIN"), F.col("admin_ip").alias("ADMINIP"), F.col("admin_name").alias("ADMINNAME"),
        F.col("host_name").alias("HOSTNAME"), F.col("id").alias("ID"), F.col("type").alias("TYPE"),
    )
    rows = S.read_components_xml(t.spark, written_xml(t, items), "machine")
    return rows.select("admin_domain", "admin_ip", "admin_name", "host_name", "id", "type")


@query("src_scan_log", """
    SELECT node, line_no, ts AS logged_at FROM $log_lines WHERE regexp_matches(line, 'owner is node [0-9]|this node has become owner')""")
def _(t):
    found = P.scan_log(t.log_lines, "owner is node [0-9]|this node has become owner")
    return found.select("node", "line_no", "logged_at")


def landed_texts(t) -> str:
    """The texts as log files, one per node, each far larger than a split; one is packed."""
    folder = work_folder(t.spark, "logs")
    rows = t.text_lines.repartitionByRange("node").sortWithinPartitions("node", "doc_id")
    for node, codec in (("node0", "none"), ("node1", "gzip"), ("node2", "none")):
        rows.filter(F.col("node") == node).coalesce(1).select("text").write.option("compression", codec).text(f"{folder}/{node}")
    return folder


@query("src_log_files", """
    SELECT node, row_number() OVER (PARTITION BY node ORDER BY doc_id, i) AS line_no, line FROM (
        SELECT node, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM $text_lines) l""")
def _(t):
    """The documents written as one file for each of three nodes and read back with the numbers of their lines."""
    return read_log_files(t.spark, landed_texts(t) + "/*/part-*", split_bytes=1 << 17).select("node", "line_no", "line")


@query("src_ws_table", r"""
    SELECT line_no, CASE WHEN ok THEN regexp_extract(line, p, 1) END AS name, CASE WHEN ok THEN regexp_extract(line, p, 2) END AS id,
           CASE WHEN ok THEN regexp_extract(line, p, 3) END AS state, CASE WHEN NOT ok THEN line END AS rejected FROM (
        SELECT *, regexp_matches(line, p) AS ok FROM (SELECT *, '^(\S+)\s+([0-9]+)\s+(Active|Inactive)\s+\S+$' AS p FROM $roster_lines) a) b""")
def _(t):
    return P.parse_whitespace_table(t.roster_lines, r"^(\S+)\s+([0-9]+)\s+(Active|Inactive)\s+\S+$", ["name", "id", "state"])


RE2_TAG = P.ATTRIBUTES.replace("'", "''")
RE2_RAW = "|".join(f"<{name}\\b{RE2_TAG}>.*?</{name}\\s*>" for name in P.RAW)
RE2_BLOCK = "|".join(P.BLOCKS)
SEEN = {
    "&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "''", "&eacute;": "\u00e9", "&#8212;": "\u2014", "&#x41;": "A", "&#151;": "\u2014",
    "&euro;": "\u20ac", "&copy;": "\u00a9", "&middot;": "\u00b7", "&amp;": "&",
}
REPLACED = "stripped"
for _entity, _char in SEEN.items():
    REPLACED = f"replace({REPLACED}, '{_entity}', '{_char}')"


@query("src_html_to_text", f"""
    SELECT page_id, array_to_string([trim(x) for x in string_split(regexp_replace({REPLACED}, '[ \\t\\r\u00a0]+', ' ', 'g'), chr(10))
                                     if trim(x) <> '' AND NOT starts_with(trim(x), 'file:')], chr(10)) AS text
    FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|{RE2_RAW}|<[!?][^>]*>', '', 'g'),
              '(?i)</?({RE2_BLOCK})([\\s/]{RE2_TAG})?>', chr(10), 'g'), '</?[a-zA-Z]{RE2_TAG}>', '', 'g') AS stripped FROM $saved_pages) s""")
def _(t):
    return t.saved_pages.select("page_id", P.html_to_text(F.col("html")).alias("text"))


STANZA_FIELDS = {"NAME": "name", "ADDRESS": "address", "VERSION": "version"}


@query("src_block_records", """
    SELECT node, name, address, version, rejected FROM (
        SELECT node, record_no, max(CASE WHEN starts_with(line, 'NAME=') THEN substring(line, 6) END) AS name,
               max(CASE WHEN starts_with(line, 'ADDRESS: ') THEN substring(line, 10) END) AS address,
               max(CASE WHEN starts_with(line, 'version=') THEN substring(line, 9) END) AS version,
               max(CASE WHEN starts_with(line, 'ADDRESS: ') THEN 1 END) IS NULL AS rejected
        FROM (SELECT *, sum(CASE WHEN line = '' THEN 1 ELSE 0 END) OVER (PARTITION BY node ORDER BY line_no) AS record_no
              FROM $stanza_lines) n WHERE line <> '' GROUP BY 1, 2) r""")
def _(t):
    return P.parse_block_records(t.stanza_lines, ["node"], STANZA_FIELDS, 500).drop("record_no")


LISTENERS = {"name": r"^Name: (.*)$", "subnet": r"^Subnet: (.*)$", "status": r"^Listener is (.*)\.$"}


@query("src_parallel_lists", r"""
    WITH m AS (
        SELECT node, CASE WHEN regexp_matches(line, '^Name: ') THEN 'name' WHEN regexp_matches(line, '^Subnet: ') THEN 'subnet'
                          WHEN regexp_matches(line, '^Listener is .*\.$') THEN 'status' END AS kind, line, line_no FROM $listener_lines),
    n AS (SELECT *, row_number() OVER (PARTITION BY node, kind ORDER BY line_no) AS member FROM m WHERE kind IS NOT NULL),
    r AS (SELECT node, member, max(CASE WHEN kind = 'name' THEN substring(line, 7) END) AS name,
                 max(CASE WHEN kind = 'subnet' THEN substring(line, 9) END) AS subnet,
                 max(CASE WHEN kind = 'status' THEN regexp_extract(line, '^Listener is (.*)\.$', 1) END) AS status, count(*) AS k
          FROM n GROUP BY 1, 2)
    SELECT node, CAST(member AS INT) AS member, name, subnet, status, min(k) OVER (PARTITION BY node) < 3 AS rejected FROM r""")
def _(t):
    return P.parse_parallel_lists(t.listener_lines, ["node"], LISTENERS)


# --- cluster log mining


@query("log_leader", """
    SELECT arg_max(CASE WHEN regexp_matches(line, 'NEW OCR MASTER IS') THEN 'node' || regexp_extract(line, 'MASTER IS ([0-9]+)', 1) ELSE node END,
                   (ts, node, file, line_no)) AS leader, max(ts) AS since FROM $cluster_log
    WHERE regexp_matches(line, 'I AM THE NEW OCR MASTER at incar|NEW OCR MASTER IS [0-9]')""")
def _(t):
    rules = [rule for rule in LEADER_RULES if rule.role == "registry"]
    return C.leaders(t.cluster_log, rules, t.roster).select("leader", "since")


@query("rep_c01", r"""
    SELECT role, arg_max(who, (ts, node, file, line_no)) AS leader, max(ts) AS since FROM (
        SELECT *, CASE WHEN line LIKE '%clssgmCMReconfig%' THEN 'group' WHEN line LIKE '%OCR MASTER%' THEN 'registry'
                       WHEN line LIKE '%PE MASTER NAME%' THEN 'policy' WHEN line LIKE '%STANDBY MASTER' OR line LIKE '%STANDBY SERVERS%' THEN 'standby'
                       WHEN line LIKE '%CTSS master' THEN 'time' WHEN line LIKE '%Master change notification%' THEN 'ui'
                       WHEN line LIKE '%ONSPROC%' THEN 'notification' WHEN line LIKE '%ONSNETPROC%' THEN 'net notification' END AS role,
               CASE WHEN line LIKE '%clssgmCMReconfig%' THEN regexp_extract(line, 'master node (.*),', 1)
                    WHEN line LIKE '%OCR MASTER IS%' THEN 'node' || regexp_extract(line, 'IS ([0-9]+)', 1)
                    WHEN line LIKE '%PE MASTER NAME%' THEN regexp_extract(line, 'NAME: (.*)', 1)
                    WHEN line LIKE '%STANDBY SERVERS%' THEN regexp_extract(line, 'SERVERS: (.*)', 1)
                    WHEN line LIKE '%CTSS master' THEN regexp_extract(line, 'msccb3: (.*) is the', 1)
                    WHEN line LIKE '%Master change%' THEN 'node' || regexp_extract(line, 'master: ([0-9]+)$', 1) ELSE node END AS who
        FROM $cluster_log) l WHERE role IS NOT NULL GROUP BY 1""")
def _(t):
    return C.leaders(t.cluster_log, LEADER_RULES, t.roster)


@query("rep_c02", r"""
    SELECT node, my_rank, min_rank, CASE WHEN my_rank > min_rank THEN '>' WHEN my_rank = min_rank THEN '=' ELSE '<' END AS compared,
           my_rank >= min_rank AS passed FROM (
        SELECT node, CAST(regexp_extract(line, 'My Rank:\[([0-9]+)\]', 1) AS INT) AS my_rank,
               CAST(regexp_extract(line, 'Min Rank:\[([0-9]+)\]', 1) AS INT) AS min_rank,
               row_number() OVER (PARTITION BY node ORDER BY ts DESC, file DESC, line_no DESC) AS rn FROM $cluster_log WHERE line LIKE '%My Rank%') r WHERE rn = 1""")
def _(t):
    return C.rank_check(t.cluster_log, RANK_PATTERN)


@query("rep_c03", r"""
    SELECT node, regexp_extract(line, 'old role \[([A-Z]+)\]', 1) AS old_role, regexp_extract(line, 'new \[([A-Z]+)\];', 1) AS new_role,
           'Starting' AS old_state, 'Running' AS new_state, ts AS logged_at FROM (
        SELECT *, row_number() OVER (PARTITION BY node ORDER BY ts DESC, file DESC, line_no DESC) AS rn FROM $cluster_log WHERE line LIKE '%PE Role%') r WHERE rn = 1""")
def _(t):
    return C.latest_match(t.cluster_log, STATE_PATTERN, ["old_role", "new_role", "old_state", "new_state"])


ATTACHED = r"""
    WITH own AS (SELECT node, max_by(regexp_extract(line, '(host |gipcha://|interconnect.)(node[0-9]+)', 2), (ts, file, line_no)) AS hub FROM $cluster_log
                 WHERE regexp_matches(line, 'PeriodicPing_CB|clssscPipeConnect|clssgmSendEventsToClients') GROUP BY 1),
    told AS (SELECT regexp_extract(line, 'memnum ([0-9]+)', 1) AS leaf_id, max_by(regexp_extract(line, 'value .([0-9]+)/', 1), (ts, node, file, line_no)) AS hub_id
             FROM $cluster_log WHERE line LIKE '%clssgmGetMemberAttr%' GROUP BY 1),
    attached AS (SELECT r.name AS leaf, coalesce(own.hub, h.name) AS hub FROM $roster r LEFT JOIN own ON own.node = r.name
                 LEFT JOIN told ON told.leaf_id = CAST(r.id AS VARCHAR) LEFT JOIN $roster h ON CAST(h.id AS VARCHAR) = told.hub_id
                 WHERE r.role = 'Leaf')"""


@query("rep_c04", ATTACHED + " SELECT * FROM attached")
def _(t):
    return C.leaf_attachment(t.cluster_log, ATTACHMENT_PATTERNS, MEMBER_PATTERN, t.roster)


@query("rep_c05", ATTACHED + """
    , lists AS (SELECT hub, string_agg(leaf, ',' ORDER BY leaf) AS leaves, page FROM (
                    SELECT hub, leaf, (row_number() OVER (PARTITION BY hub ORDER BY leaf) - 1) // 20 AS page
                    FROM (SELECT DISTINCT coalesce(hub, 'N/A') AS hub, leaf FROM attached) d) a GROUP BY 1, 3),
    hubs AS (SELECT name AS hub FROM $roster WHERE role = 'Hub')
    SELECT coalesce(h.hub, l.hub) AS hub, h.hub IS NOT NULL AS in_roster, leaves, page FROM hubs h FULL JOIN lists l ON l.hub = h.hub""")
def _(t):
    attached = C.leaf_attachment(t.cluster_log, ATTACHMENT_PATTERNS, MEMBER_PATTERN, t.roster)
    return C.hub_listing(t.roster, attached, 20)


@query("rep_c06", r"""
    WITH e AS (SELECT node, line_no, line, lag(line) OVER (PARTITION BY node ORDER BY line_no) AS p FROM $storage_log),
    m AS (SELECT node, regexp_extract(line, 'client (\S+) opening', 1) AS client, CAST(p AS TIMESTAMP) AS connected_at FROM e
          WHERE line LIKE 'NOTE: client%')
    SELECT client, connected_at, string_agg(DISTINCT node, ',' ORDER BY node) AS servers FROM m
    WHERE connected_at = (SELECT max(connected_at) FROM m x WHERE x.client = m.client) GROUP BY 1, 2""")
def _(t):
    return C.storage_connections(t.storage_log, r"^NOTE: client (\S+) opening", 1000)


@query("rep_c07", """
    SELECT CASE WHEN rn = 1 THEN group_name ELSE '' END AS group_name, CASE WHEN rn = 1 THEN CAST(total_mb AS VARCHAR) ELSE '' END AS total_mb,
           group_number, disk_no, path FROM (
        SELECT *, row_number() OVER (PARTITION BY group_number ORDER BY disk_no) AS rn FROM $disks JOIN $disk_groups USING (group_number)) d""")
def _(t):
    joined = lookup_join(t.disks, t.disk_groups, ["group_number"], "inner").select("group_name", "total_mb", "group_number", "disk_no", "path")
    chunk = F.floor(F.col("disk_no") / 500)
    shown = C.suppress_repeats(joined, "group_number", "disk_no", ["group_name", "total_mb"], chunk)
    return shown.orderBy("group_number", "disk_no")


@query("rep_c08", """
    SELECT DISTINCT volume_name, group_name, coalesce(mountpath, 'N/A') AS mountpath, coalesce(usage, 'N/A') AS usage,
           round(coalesce(size_mb, 0), 0) AS size_mb FROM $volumes JOIN $disk_groups USING (group_number)""")
def _(t):
    return C.volumes(t.volumes, t.disk_groups)


@query("rep_c09", """
    SELECT DISTINCT group_name, coalesce(client, 'None') AS client FROM $disk_groups g LEFT JOIN $storage_users c ON c.group_number = g.group_number""")
def _(t):
    return C.storage_clients(t.disk_groups, t.storage_users)


@query("rep_c10", """
    SELECT host, max(CASE WHEN line_no = 1 THEN substring(line, 16) END) AS name,
           max(CASE WHEN line_no = 3 THEN nullif(substring(line, 16), '') END) AS role,
           max(CASE WHEN line_no = 2 THEN 'data' || regexp_extract(line, 'DATA([0-9]+)', 1) || ',fra' END) AS disk_groups
    FROM $db_config_lines GROUP BY 1""")
def _(t):
    fields = {"name": ("Database name",), "role": ("Database role",), "groups": ("Disk Groups",)}
    rows = P.parse_kv_status(t.db_config_lines, fields)
    unique = F.array_sort(F.array_distinct(F.split(F.lower("groups"), ",")))
    return rows.select("host", "name", "role", F.array_join(unique, ",").alias("disk_groups"))


@query("rep_c11", r"""
    SELECT DISTINCT name, id, state, CASE WHEN role <> 'None' THEN role WHEN id < 100 THEN 'Hub' ELSE 'Leaf' END AS role FROM (
        SELECT regexp_extract(line, p, 1) AS name, CAST(regexp_extract(line, p, 2) AS INT) AS id, regexp_extract(line, p, 3) AS state,
               regexp_extract(line, p, 4) AS role FROM (SELECT line, '^(\S+)\s+([1-9][0-9]*)\s+(Active|Inactive)\s+(Hub|Leaf|None)$' AS p
                                                        FROM $roster_lines) a WHERE regexp_matches(line, p)) b""")
def _(t):
    return C.node_roster(t.roster_lines)


TIMEOUT_COLUMNS = ", ".join(
    f"max_by(CASE WHEN name = '{n}' THEN value END, CASE WHEN name = '{n}' THEN (file, line_no) END) AS {n}" for n in C.TIMEOUTS
)


@query("rep_c12", f"""
    SELECT node, {TIMEOUT_COLUMNS} FROM (
        SELECT node, file, line_no, regexp_extract(line, 'get (\\S+) ([0-9]+) for', 1) AS name,
               CAST(regexp_extract(line, 'get (\\S+) ([0-9]+) for', 2) AS INT) AS value FROM $css_lines) v GROUP BY 1""")
def _(t):
    return C.timeouts(t.css_lines)


@query("rep_c13", """
    SELECT 'node' || s_nationkey AS node, 'eth' || s_suppkey AS nic, '10.0.' || s_nationkey || '.0' AS subnet, 'global' AS scope, 'public' AS purpose,
           CASE WHEN s_acctbal <= 8000 THEN '255.255.255.0' END AS netmask FROM $supplier WHERE s_acctbal >= 0""")
def _(t):
    return C.interfaces(t.getif_lines, t.iflist_lines)


@query("rep_c14", r"""
    SELECT DISTINCT regexp_extract(line, '\((.*)\) \[(.*)\]', 1) AS location, regexp_extract(line, '\((.*)\) \[(.*)\]', 2) AS group_name
    FROM $location_lines""")
def _(t):
    rows = P.parse_whitespace_table(t.location_lines, r"\((.*)\) \[(.*)\]", ["location", "group_name"])
    return rows.filter("rejected IS NULL").select("location", "group_name").distinct()


# Cluster facts and the command output they are read from.
CLUSTER_FACTS = (
    ("active version", r"Active version on the cluster is \[([0-9.]+)\]"),
    ("scan name", r"^SCAN name: (\S+),"),
    ("mode", r'running in "(\w+)" mode'),
    ("listener nodes", r"is running on node\(s\): (.*)$"),
    ("name service domain", r"^GNS domain: (.*)$"),
    ("software version", r"version on node \S+ is \[([0-9.]+)\]"),
    ("release version", r"release version on the local node is \[([0-9.]+)\]"),
    ("management listener", r"^Listener MGMTLSNR is (enabled|disabled)$"),
    ("management database", r"^Instance -MGMTDB is running on node (\S+)$"),
)

#: Plain text that every line of the fact holds.
FACT_NEEDLES = (
    "Active version on the cluster", "SCAN name: ", "running in ", "is running on node(s): ", "GNS domain: ", "version on node ",
    "release version on the local node", "Listener MGMTLSNR is ", "Instance -MGMTDB is ",
)


@query("rep_c15", " UNION ALL ".join(
    f"SELECT node, '{fact}' AS fact, max_by(regexp_extract(line, '{p}', 1), (file, line_no)) AS value FROM $fact_lines "
    f"WHERE regexp_matches(line, '{p}') GROUP BY 1" for fact, p in CLUSTER_FACTS
))
def _(t):
    return C.facts(t.fact_lines, CLUSTER_FACTS)


@query("log_rule_table", " UNION ALL ".join(
    f"SELECT node, '{fact}' AS rule, max_by(regexp_extract(line, '{p}', 1), (file, line_no)) AS value FROM $fact_lines "
    f"WHERE regexp_matches(line, '{p}') GROUP BY 1" for fact, p in CLUSTER_FACTS
))
def _(t):
    """The cluster facts with the rules as a table; the rest of a thousand rules fits no line."""
    known = [(fact, needle, pattern) for (fact, pattern), needle in zip(CLUSTER_FACTS, FACT_NEEDLES)]
    others = [(f"other {k}", f"rule number {k} ", f"rule number {k} ([0-9]+)") for k in range(1000 - len(known))]
    rules = t.spark.createDataFrame(known + others, "rule string, needle string, pattern string")
    found = match_rules(t.fact_lines, rules)
    newest = found.groupBy("node", "rule").agg(F.max_by(F.col("groups")[0], F.struct("file", "line_no")).alias("value"))
    return newest.select("node", "rule", "value")


@query("rep_c15_addresses", """
    SELECT 'node' || s_nationkey % 3 AS node, 'host' || s_suppkey AS name,
           CASE WHEN s_nationkey < 14 THEN '10.0.' || s_nationkey || '.' || s_suppkey % 200 ELSE 'vip' || s_suppkey || '.example.org' END AS address,
           CASE WHEN s_nationkey < 14 THEN 'dynamic' ELSE 'static' END AS kind, '12.1.0.' || s_nationkey AS version
    FROM $supplier WHERE s_acctbal >= 0 AND s_nationkey >= 4""")
def _(t):
    return C.node_addresses(t.profile_lines, 100)


@query("rep_c16", """
    SELECT min_by(answer, node_order) AS answer, min(node_order) AS node_order FROM $monitor_answers
    WHERE answer <> '' AND question = CASE version WHEN '12.1.0.2' THEN 'new key' ELSE 'old key' END""")
def _(t):
    return C.monitor_master(t.monitor_answers, F.col("version"), "12.1", "new key", "old key")


@query("rep_c17", r"""
    SELECT node, coalesce(l.v, p.v) AS instance FROM
        (SELECT node, max_by(regexp_extract(line, '^(\+ASM[0-9]*):', 1), (file, line_no)) AS v FROM $instance_roster_lines WHERE line LIKE '+ASM%' GROUP BY 1) l
        FULL JOIN (SELECT node, max_by(regexp_extract(line, '_pmon_(\+ASM[0-9]+)$', 1), (file, line_no)) AS v FROM $process_lines
                   WHERE line LIKE '%_pmon_%' GROUP BY 1) p USING (node)""")
def _(t):
    return C.instance_names(t.instance_roster_lines, t.process_lines, "+ASM")


# --- audits


@query("audit_host_mapping", """
    SELECT d.host_name, d.ip, r.ip AS resolved_ip, d.domain, r.domain AS resolved_domain,
           CASE WHEN r.ip IS NULL THEN 'unresolved' WHEN r.ip <> d.ip THEN 'address differs' WHEN lower(r.domain) <> d.domain THEN 'domain differs'
                ELSE 'ok' END AS verdict FROM $declared_hosts d LEFT JOIN $resolved_hosts r ON r.host_name = d.host_name""")
def _(t):
    return G.host_mapping_audit(t.declared_hosts, t.resolved_hosts)


@query("audit_domain", """
    SELECT host_id, found, configured, verdict, verdict IN ('same', 'configured empty') AS passed FROM (SELECT *,
        CASE WHEN f = '' AND c = '' THEN 'both empty' WHEN f = c THEN 'same' WHEN f = '' THEN 'found empty' WHEN c = '' THEN 'configured empty'
             ELSE 'different' END AS verdict
        FROM (SELECT *, CASE WHEN found = '(none)' THEN '' ELSE found END AS f, configured AS c FROM $host_domains) d) v""")
def _(t):
    return G.domain_audit(t.host_domains)


@query("audit_cipher", """
    SELECT node, CASE WHEN ciphers LIKE 'aes128%' THEN 'aes128-ctr,aes256-ctr' ELSE '' END AS matching, ciphers LIKE 'aes128%' AS passed
    FROM $node_ciphers""")
def _(t):
    return G.cipher_audit(t.node_ciphers, ["aes128-ctr", "aes256-ctr", "aes192-ctr"])


# --- readiness gates

TODAY = "2001-09-01 00:00:00"


@query("rep_u01", f"""
    WITH n AS (SELECT p_name AS name, max(CASE WHEN l_linenumber <= 3 THEN l_shipdate END) AS f, max(CASE WHEN l_linenumber > 3 THEN l_shipdate END) AS i
               FROM $lineitem JOIN $part ON p_partkey = l_partkey GROUP BY 1),
    w AS (SELECT round(max(round(epoch(TIMESTAMP '{TODAY}' - f) / 86400.0::DOUBLE, 2)), 0) AS f,
                 round(max(round(epoch(TIMESTAMP '{TODAY}' - i) / 86400.0::DOUBLE, 2)), 0) AS i FROM n WHERE f IS NOT NULL AND i IS NOT NULL)
    SELECT 'full backup age in days' AS rule, f AS observed, '<=' AS comparison, 6.0::DOUBLE AS required, f <= 6 AS passed FROM w
    UNION ALL SELECT 'incremental backup age in days', i, '<=', 2.0, i <= 2 FROM w""")
def _(t):
    level = F.when(F.col("l_linenumber") <= 3, 0).otherwise(1)
    backups = t.lineitem.select(
        F.col("l_partkey").alias("file_no"), level.alias("incremental_level"), F.col("l_shipdate").alias("completion_time")
    )
    files = t.part.select(F.col("p_partkey").alias("file_no"), F.col("p_name").alias("name"))
    return U.backup_age(backups, files, as_ntz(TODAY))


@query("rep_u02", """
    SELECT host AS name, version AS reported, rec AS recorded, '40.10.1' AS target, agrees, higher AS target_is_higher, agrees AND higher AS passed
    FROM (SELECT host, version, CASE WHEN v1 = 33 THEN v1 || '.' || v2 ELSE version END AS rec, NOT (v1 = 33 AND (v3 <> -1 OR sfx <> '')) AS agrees,
                 (40, 10, 1, '') > (v1, v2, v3, sfx) AS higher FROM $versions) v""")
def _(t):
    reported = t.versions.select(F.col("host").alias("name"), "version")
    recorded = t.versions.select(
        F.col("host").alias("name"),
        F.when(F.col("v1") == 33, F.concat_ws(".", F.col("v1").cast("string"), F.col("v2").cast("string")))
        .otherwise(F.col("version")).alias("version"),
    )
    return U.release_check(reported, recorded, "40.10.1")


@query("rep_u03", """
    SELECT pool / 1048576.0::DOUBLE AS current_mb, 80 + 15 * (cache / 1048576.0::DOUBLE / 256) + 5 * (procs / 100.0::DOUBLE) AS required_mb,
           pool / 1048576.0::DOUBLE > 80 + 15 * (cache / 1048576.0::DOUBLE / 256) + 5 * (procs / 100.0::DOUBLE) AS passed FROM (
        SELECT sum(CASE WHEN name = 'sga_target' THEN value END)::BIGINT AS pool, sum(CASE WHEN name = 'memory_target' THEN value END)::BIGINT AS cache,
               (SELECT count(*) FROM $processes) AS procs FROM $parameters) p""")
def _(t):
    names = F.when(F.col("name") == "sga_target", "pool").when(F.col("name") == "memory_target", "cache")
    settings = t.parameters.select(names.alias("name"), "value").unionByName(
        t.processes.agg(F.count("*").alias("value")).select(F.lit("processes").alias("name"), "value")
    )
    return U.pool_size(settings)


@query("rep_u04", """
    WITH o AS (SELECT p_partkey AS id, CASE WHEN p_size < 10 THEN 'JOURNAL_' || (p_partkey + 1) WHEN p_size < 20 THEN 'TOP_' || (p_partkey - 1)
                      ELSE p_name END AS name, p_size * 64 AS flags FROM $part)
    SELECT count(*) AS journals, count(r.id) AS rebuilt, count(t.name) AS with_top, count(*) = 0 AS passed FROM (SELECT * FROM o WHERE name LIKE 'JOURNAL%') j
    LEFT JOIN (SELECT * FROM o WHERE flags & 512 = 512) r ON 'JOURNAL_' || r.id = j.name
    LEFT JOIN (SELECT DISTINCT name FROM o WHERE name LIKE 'TOP%') t ON t.name = 'TOP_' || j.id""")
def _(t):
    name = (
        F.when(F.col("p_size") < 10, F.concat(F.lit("JOURNAL_"), F.col("p_partkey") + 1))
        .when(F.col("p_size") < 20, F.concat(F.lit("TOP_"), F.col("p_partkey") - 1)).otherwise(F.col("p_name"))
    )
    objects = t.part.select(F.col("p_partkey").alias("object_id"), name.alias("object_name"), (F.col("p_size") * 64).alias("flags"))
    return U.journal_objects(objects.drop("flags"), objects.select("object_id", "flags"))


@query("rep_u05", """
    SELECT 'settings rows' AS rule, count(*)::DOUBLE AS observed, '<=' AS comparison, 1.0::DOUBLE AS required, count(*) <= 1 AS passed FROM $region
    UNION ALL SELECT 'corrupt blocks', count(*), '=', 0.0, count(*) = 0 FROM $lineitem WHERE l_discount > 1
    UNION ALL SELECT 'guaranteed restore points', count(*), '=', 0.0, count(*) = 0 FROM $orders WHERE o_orderstatus = 'P'""")
def _(t):
    return U.count_limits(t.region, t.lineitem.filter("l_discount > 1"), t.orders.filter("o_orderstatus = 'P'"))


@query("rep_u06", """
    SELECT 'space in MB' AS rule, sum(bytes) / 1048576.0::DOUBLE AS observed, '>=' AS comparison, 5120.0::DOUBLE AS required,
           sum(bytes) / 1048576.0::DOUBLE >= 5120 AS passed FROM $data_files
    UNION ALL SELECT 'statistics tables above 512 MB', count(*), '=', 0.0, count(*) = 0 FROM (
        SELECT segment_name FROM $segments GROUP BY 1 HAVING sum(bytes) / 1048576.0 > 512) s""")
def _(t):
    return U.space_limits(t.data_files, t.segments)


@query("rep_u07", "SELECT s_suppkey AS db_no, s_nationkey AS version, s_nationkey IN (4, 14) AS passed FROM $supplier")
def _(t):
    return U.time_zone(t.supplier.select(F.col("s_suppkey").alias("db_no"), F.col("s_nationkey").alias("version")))


@query("rep_u08", """
    SELECT 'invalid objects' AS item, count(*) AS n FROM $objects WHERE status = 'INVALID'
    UNION ALL SELECT 'invalid object kinds', count(*) FROM (SELECT DISTINCT owner, object_type FROM $objects WHERE status = 'INVALID') k
    UNION ALL SELECT 'indexes ' || status, count(*) FROM $indexes GROUP BY status""")
def _(t):
    return U.after_run(t.objects, t.indexes)


# --- versioned rows

AS_OF = "1999-01-01 00:00:00"


@query("row_ttl_stamp", """
    SELECT key, write_ts, write_ts + CASE WHEN ttl IS NOT NULL THEN ttl WHEN write_ts >= TIMESTAMP '1998-01-01 00:00:00' THEN
               CASE table_name WHEN 'short' THEN 86400 WHEN 'long' THEN 2592000 END END * INTERVAL 1 SECOND AS expires_at FROM $ttl_rows""")
def _(t):
    stamped = V.stamp_ttl(t.ttl_rows, {"short": 86400, "long": 2592000}, as_ntz("1998-01-01 00:00:00"))
    return stamped.select("key", "write_ts", "expires_at")


@query("row_ttl_expire", f"""
    SELECT key, replica, coalesce(expires_at, write_ts + INTERVAL 1000 DAY) AS expires_at FROM $versioned_rows
    WHERE coalesce(expires_at, write_ts + INTERVAL 1000 DAY) > TIMESTAMP '{AS_OF}'""")
def _(t):
    kept = V.expire(V.backfill_ttl(t.versioned_rows, 1000 * 86400), as_ntz(AS_OF))
    return kept.select("key", "replica", "expires_at")


@query("row_tombstone_purge", f"""
    SELECT key, replica FROM $versioned_rows WHERE deleted_at IS NULL OR deleted_at > TIMESTAMP '{AS_OF}' - INTERVAL 864000 SECOND""")
def _(t):
    return V.purge_tombstones(t.versioned_rows, as_ntz(AS_OF)).select("key", "replica")


@query("row_compact", f"""
    SELECT key, payload, write_ts, deleted_at FROM (
        SELECT *, row_number() OVER (PARTITION BY key ORDER BY write_ts DESC, deleted_at IS NOT NULL DESC, payload DESC) AS rn
        FROM $versioned_rows) r
    WHERE rn = 1 AND (deleted_at IS NULL OR deleted_at > TIMESTAMP '{AS_OF}' - INTERVAL 864000 SECOND)""")
def _(t):
    rows = V.compact_versions(t.versioned_rows, ["key"], as_ntz(AS_OF))
    return rows.select("key", "payload", "write_ts", "deleted_at")


@query("row_replica_diff", """
    WITH newest AS (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key, replica ORDER BY write_ts DESC, deleted_at IS NOT NULL DESC, payload DESC) AS rn
                       FROM $versioned_rows) r WHERE rn = 1)
    SELECT key, count(DISTINCT (payload, write_ts, deleted_at)) AS versions, (SELECT count(DISTINCT replica) FROM newest) - count(*) AS missing,
           arg_max(payload, (write_ts, deleted_at IS NOT NULL, payload)) AS newest_payload, max(write_ts) AS newest_write FROM newest GROUP BY 1
    HAVING count(DISTINCT (payload, write_ts, deleted_at)) > 1 OR count(*) < (SELECT count(DISTINCT replica) FROM newest)""")
def _(t):
    return V.replica_diff(t.versioned_rows)


@query("row_range_diff", """
    WITH a AS (SELECT * FROM $copied_rows WHERE copy = 'a'), b AS (SELECT * FROM $copied_rows WHERE copy = 'b')
    SELECT 'b' AS copy, coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'missing' WHEN a.key IS NULL THEN 'extra' ELSE 'changed' END AS difference
    FROM a FULL JOIN b ON a.key = b.key
    WHERE a.key IS NULL OR b.key IS NULL OR (a.part_key, a.payload, a.write_ts) IS DISTINCT FROM (b.part_key, b.payload, b.write_ts)""")
def _(t):
    copies = {name: t.copied_rows.filter(F.col("copy") == name).drop("copy") for name in ("a", "b")}
    return range_diff(copies, ["key"], ["part_key", "payload", "write_ts"])


@query("row_rewrite_partitions", f"""
    SELECT key, replica, part FROM $parted_rows WHERE deleted_at IS NULL OR deleted_at > TIMESTAMP '{AS_OF}' - INTERVAL 864000 SECOND""")
def _(t):
    """A landed table with its old tombstones purged; only partitions that had some are written."""
    folder, as_of = work_folder(t.spark, "parted"), as_ntz(AS_OF)
    t.parted_rows.write.partitionBy("part").parquet(folder)
    schema = t.parted_rows.schema
    gone = F.col("deleted_at") <= as_of - F.expr(f"INTERVAL {V.GC_GRACE} SECOND")
    rewrite_partitions(t.spark, folder, schema, ["part"], gone, lambda rows: V.purge_tombstones(rows, as_of))
    return t.spark.read.schema(schema).parquet(folder).select("key", "replica", "part")


@query("log_pair_duration", """
    SELECT thread, line_no, logged_at AS started, nt AS finished, (epoch_us(nt) - epoch_us(logged_at)) / 1000000.0::DOUBLE AS seconds FROM (
        SELECT *, lead(event_type) OVER w AS ne, lead(logged_at) OVER w AS nt FROM $compaction_log WHERE event_type <> 'purchase'
        WINDOW w AS (PARTITION BY thread ORDER BY line_no)) c
    WHERE event_type IN ('signup', 'view') AND ne IN ('error', 'click')""")
def _(t):
    return V.pair_durations(t.compaction_log, "- Compacting ", "- Compacted to ", 1000)


@query("log_trace_events", """
    SELECT line_no, logged_at, line FROM $compaction_log WHERE thread = 'exec1' ORDER BY logged_at, line_no""")
def _(t):
    return V.trace_events(t.compaction_log, "exec1")


@query("log_latest_history", "SELECT * FROM $backup_jobs ORDER BY end_time DESC, session_recid DESC LIMIT 1")
def _(t):
    return top_n(t.backup_jobs, [F.col("end_time").desc(), F.col("session_recid").desc()], 1)


@query("log_tombstone_counts", """
    SELECT dc, payload, count(deleted_at) AS tombstones FROM $versioned_rows GROUP BY 1, 2""")
def _(t):
    return t.versioned_rows.groupBy("dc", "payload").agg(F.count("deleted_at").alias("tombstones"))
