"""Facts about a cluster from the collected logs and command output of its nodes."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import version_at_least
from tidemark.operators.aggregates import member_list
from tidemark.operators.checks import first_match
from tidemark.operators.joins import full_reconcile, previous_line
from tidemark.operators.skew import lookup_join, with_neighbour
from tidemark.sources.lines import newest
from tidemark.sources.text import parse_block_records, scan_log, with_stamp
from tidemark.specs import LeaderRule


def leaders(lines: DataFrame, rules: Sequence[LeaderRule], roster: DataFrame) -> DataFrame:
    """The leader of every role, by the newest line of any node that names one; all roles in one pass.

    A line can say that its own node leads, or give the leader's name, or its number in ``roster`` (id, name).
    """
    line = F.col("line")
    # The first rule whose needle a line holds and whose pattern it fits; one pattern is tried for most lines.
    rule_no = F.lit(None).cast("int")
    for number, rule in reversed(list(enumerate(rules))):
        rule_no = F.when(line.contains(rule.needle) & line.rlike(rule.pattern), F.lit(number)).otherwise(rule_no)
    # One look at the line for all needles: a computed line is then computed once.
    named = line.rlike("|".join(re.escape(needle) for needle in sorted({rule.needle for rule in rules})))
    found = with_stamp(lines.filter(named)).withColumn("_rule", rule_no)
    last = found.groupBy("_rule").agg(
        F.max_by(F.struct("node", "line", "logged_at"), _place(found)).alias("_l"), F.max(_place(found)).alias("_p"), F.max("_rule").alias("_known")
    ).filter("_known IS NOT NULL")
    # One line for each rule is left: its name is cut out here, and the newest rule of each role counts.
    who, role, names = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for number, rule in enumerate(rules):
        own = F.col("_rule") == number
        said = F.col("_l.node") if rule.names == "self" else F.trim(F.regexp_extract("_l.line", rule.pattern, 1))
        who, role, names = F.when(own, said).otherwise(who), F.when(own, F.lit(rule.role)).otherwise(role), F.when(own, F.lit(rule.names)).otherwise(names)
    claims = last.select(role.alias("role"), names.alias("names"), who.alias("who"), F.col("_l.logged_at").alias("logged_at"), "_p")
    newest_claim = claims.groupBy("role").agg(F.max_by(F.struct("names", "who", "logged_at"), "_p").alias("_l"))
    rows = newest_claim.select(
        "role", "_l.names", "_l.who", F.col("_l.logged_at").alias("since"),
        F.when(F.col("_l.names") == "id", F.col("_l.who")).alias("id"),
    )
    ids = roster.select(F.col("id").cast("string").alias("id"), "name")
    named = rows.join(ids, "id", "left")
    leader = F.when(F.col("names") == "id", F.col("name")).otherwise(F.col("who"))
    return named.select("role", F.coalesce(leader, F.lit("N/A")).alias("leader"), "since")


def _place(lines: DataFrame):
    """The order of lines of all nodes: stamp, node, file, line."""
    place = newest(lines)
    return F.struct(place["logged_at"].alias("logged_at"), "node", place.alias("place"))


def latest_match(lines: DataFrame, pattern: str, columns: Sequence[str]) -> DataFrame:
    """The groups of the newest line of each node that fits ``pattern``."""
    found = scan_log(lines, pattern)
    groups = F.struct(*[F.regexp_extract("line", pattern, i + 1).alias(c) for i, c in enumerate(columns)], "logged_at")
    latest = found.groupBy("node").agg(F.max_by(groups, newest(found)).alias("_g"))
    return latest.select("node", "_g.*")


def rank_check(lines: DataFrame, pattern: str) -> DataFrame:
    """Own rank against the least rank by the newest rank line of each node; ``pattern`` captures both."""
    ranks = latest_match(lines, pattern, ["mine", "least"])
    mine, least = F.col("mine").cast("int"), F.col("least").cast("int")
    verdict = F.when(mine > least, ">").when(mine == least, "=").otherwise("<")
    return ranks.select(
        "node", mine.alias("my_rank"), least.alias("min_rank"), verdict.alias("compared"), (mine >= least).alias("passed")
    )


def leaf_attachment(lines: DataFrame, patterns: Sequence[str], member_pattern: str, roster: DataFrame) -> DataFrame:
    """The hub of every leaf: by the first pattern that the leaf's own log answers, else by what others say.

    ``member_pattern`` captures the leaf's number and the hub's number. ``roster`` has id, name and role.
    """
    by_name = roster.select(F.col("id").cast("string").alias("id"), "name", "role")
    leaves = by_name.filter("role = 'Leaf'").select(F.col("name").alias("node"), F.col("id").alias("leaf_id"))
    any_pattern = "|".join(f"(?:{p})" for p in patterns)
    answers, members = scan_log(lines, any_pattern), scan_log(lines, member_pattern)
    own = answers.groupBy("node").agg(first_match(F.col("line"), patterns, newest(answers)).alias("own_hub"))
    said = members.groupBy(F.regexp_extract("line", member_pattern, 1).alias("leaf_id")).agg(
        F.max_by(F.regexp_extract("line", member_pattern, 2), _place(members)).alias("hub_id")
    )
    hubs = by_name.select(F.col("id").alias("hub_id"), F.col("name").alias("said_hub"))
    told = said.join(hubs, "hub_id")
    return leaves.join(own, "node", "left").join(told, "leaf_id", "left").select(
        F.col("node").alias("leaf"), F.coalesce("own_hub", "said_hub").alias("hub")
    )


def hub_listing(roster: DataFrame, attachments: DataFrame, page_size: int | None = None) -> DataFrame:
    """Hubs with their leaves, hubs without any, and leaves whose hub is unknown; ``page_size`` is that of ``member_list``."""
    hubs = roster.filter("role = 'Hub'").select(F.col("name").alias("hub"))
    known = full_reconcile(hubs, attachments.filter("hub IS NOT NULL"), ["hub"])
    lists = member_list(attachments.withColumn("hub", F.coalesce("hub", F.lit("N/A"))), ["hub"], "leaf", "leaves", page_size)
    listed = known.join(lists, "hub", "left").select("hub", "in_left", *[c for c in lists.columns if c != "hub"])
    stray = lists.filter("hub = 'N/A'").withColumn("in_left", F.lit(False))
    return listed.unionByName(stray).withColumnRenamed("in_left", "in_roster")


def storage_connections(lines: DataFrame, pattern: str, chunk_lines: int = 10000) -> DataFrame:
    """For each client, the servers whose log shows its newest connection; equal times are all listed.

    A connection is a line that fits ``pattern`` (which captures the client) below a line with the time.
    """
    paired = previous_line(lines, chunk_lines).filter(F.col("line").rlike(pattern))
    events = paired.select(
        F.regexp_extract("line", pattern, 1).alias("client"), "node",
        F.col("previous_line").try_cast("timestamp_ntz").alias("connected_at"),
    )
    per_server = events.groupBy("client", "node").agg(F.max("connected_at").alias("connected_at"))
    latest = per_server.groupBy("client").agg(F.max("connected_at").alias("connected_at"))
    servers = per_server.join(latest, ["client", "connected_at"])
    return member_list(servers, ["client", "connected_at"], "node", "servers")


def suppress_repeats(df: DataFrame, group: str, order: str, columns: Sequence[str], chunk: Column) -> DataFrame:
    """Blanks ``columns`` on every row of a group but its first."""
    paired = with_neighbour(df, [group], [order], [order], chunk, name="_p")
    first = F.col("_p").isNull()
    return paired.select(*[
        F.when(first, F.col(c).cast("string")).otherwise("").alias(c) if c in columns else F.col(c) for c in df.columns
    ])


def volumes(volumes: DataFrame, groups: DataFrame) -> DataFrame:
    """Distinct volumes with their disk group; missing mount points and uses get a placeholder, sizes a zero."""
    joined = lookup_join(volumes, groups.select("group_number", "group_name"), ["group_number"], "inner")
    return joined.select(
        "volume_name", "group_name", F.coalesce("mountpath", F.lit("N/A")).alias("mountpath"),
        F.coalesce("usage", F.lit("N/A")).alias("usage"), F.round(F.coalesce("size_mb", F.lit(0.0)), 0).alias("size_mb"),
    ).distinct()


def storage_clients(groups: DataFrame, clients: DataFrame) -> DataFrame:
    """Disk groups with their clients, or ``None``."""
    joined = groups.select("group_number", "group_name").join(clients, "group_number", "left")
    return joined.select("group_name", F.coalesce("client", F.lit("None")).alias("client")).distinct()


def node_roster(lines: DataFrame) -> DataFrame:
    """Node, number, state and role; an inactive node's role follows from its number (below 100 a hub)."""
    pattern = r"^(\S+)\s+([1-9]\d*)\s+(Active|Inactive)\s+(Hub|Leaf|None)$"
    line = F.col("line")
    fits = line.rlike(pattern)
    number = F.regexp_extract(line, pattern, 2).try_cast("int")
    role = F.regexp_extract(line, pattern, 4)
    rows = lines.filter(fits).select(
        F.regexp_extract(line, pattern, 1).alias("name"), number.alias("id"), F.regexp_extract(line, pattern, 3).alias("state"),
        F.when(role != "None", role).when(number < 100, "Hub").otherwise("Leaf").alias("role"),
    )
    return rows.distinct()


# Names of the cluster timeouts.
TIMEOUTS = ("diagwait", "disktimeout", "misscount", "leafmisscount", "reboottime")


def timeouts(lines: DataFrame) -> DataFrame:
    """The timeout settings of each node, one column per setting."""
    pattern = r"Successful get (\w+) (\d+) for Cluster Synchronization Services"
    found = scan_log(lines, pattern)
    found = found.select(
        "node", newest(found).alias("place"), F.regexp_extract("line", pattern, 1).alias("name"),
        F.regexp_extract("line", pattern, 2).cast("int").alias("value"),
    )
    return found.groupBy("node").pivot("name", list(TIMEOUTS)).agg(F.max_by("value", "place"))


def interfaces(getif: DataFrame, iflist: DataFrame) -> DataFrame:
    """Interfaces with subnet and use from one listing and the netmask from the other."""
    use = r"^(\S+)\s+(\S+)\s+(\S+)\s+(\S+)$"
    mask = r"^(\S+)\s+(\S+)\s+(\S+)$"

    def cut(df: DataFrame, pattern: str, names: Sequence[str]) -> DataFrame:
        # Lines that begin like this are messages, whatever follows.
        kept = df.filter(F.col("line").rlike(pattern) & ~F.col("line").rlike("^Only in OCR:|^PRIF-29:"))
        return kept.select("node", *[F.regexp_extract("line", pattern, i + 1).alias(n) for i, n in enumerate(names)])

    left = cut(getif, use, ["nic", "subnet", "scope", "purpose"])
    right = cut(iflist, mask, ["nic", "subnet", "netmask"]).distinct()
    return left.join(right, ["node", "nic", "subnet"], "left")


def facts(lines: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Named facts from command output: ``rules`` are (fact, pattern with one group); the newest line counts."""
    line = F.col("line")
    found = F.array_compact(F.array(*[
        F.when(line.rlike(p), F.struct(F.lit(fact).alias("fact"), F.regexp_extract(line, p, 1).alias("value")))
        for fact, p in rules
    ]))
    pairs = with_stamp(lines).withColumn("_f", F.explode(found))
    return pairs.groupBy("node", "_f.fact").agg(F.max_by("_f.value", newest(pairs)).alias("value"))


def node_addresses(lines: DataFrame, lines_per_chunk: int = 10000) -> DataFrame:
    """(node, name, address, kind, version) of the virtual address of every cluster node, from resource profiles.

    Profiles are stanzas with ``NAME=ora.<name>.vip`` and ``USR_ORA_VIP=<address>``; others are left out. An address in
    numbers is ``dynamic``, a name is ``static``.
    """
    fields = {"NAME": "name", "USR_ORA_VIP": "address", "VERSION": "version"}
    records = parse_block_records(lines, ["node"], fields, lines_per_chunk)
    pattern = r"^ora\.(.*)\.vip$"
    kind = F.when(F.col("address").rlike(r"^\d+(\.\d+){3}$"), "dynamic").otherwise("static")
    found = records.filter(F.col("name").rlike(pattern) & F.col("address").isNotNull())
    return found.select("node", F.regexp_extract("name", pattern, 1).alias("name"), "address", kind.alias("kind"), "version")


def first_answer(answers: DataFrame, order: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """The non-empty value of the first node in ``order`` that gives one."""
    given = answers.filter(F.trim(F.coalesce(F.col(value), F.lit(""))) != "")
    return given.groupBy(*keys).agg(F.min_by(value, order).alias(value), F.min(order).alias(order))


def monitor_master(answers: DataFrame, version: Column, newest: str, new_key: str, old_key: str) -> DataFrame:
    """The answer of the first node, by the key that its software version uses."""
    wanted = F.when(version_at_least(version, F.lit(newest)), F.lit(new_key)).otherwise(F.lit(old_key))
    return first_answer(answers.filter(F.col("question") == wanted), "node_order", "answer")


def instance_names(roster_lines: DataFrame, process_lines: DataFrame, prefix: str) -> DataFrame:
    """Instance per node: the newest entry of the instance roster, else what the process list shows."""
    entry = rf"^(\{prefix}\d*):"
    process = rf"_pmon_(\{prefix}\d+)$"

    def last(df: DataFrame, pattern: str, name: str) -> DataFrame:
        fit = scan_log(df, pattern)
        return fit.groupBy("node").agg(F.max_by(F.regexp_extract("line", pattern, 1), newest(fit)).alias(name))

    joined = last(roster_lines, entry, "listed").join(last(process_lines, process, "running"), "node", "full")
    return joined.select("node", F.coalesce("listed", "running").alias("instance"))
