"""Descriptions of counter sets, rules and patterns. Data only; the operators give them meaning."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Ratio:
    """``scale * numerator / denominator`` of two counter deltas; zero without a positive denominator."""

    name: str
    numerator: str
    denominator: str
    scale: float = 1.0


@dataclass(frozen=True)
class CounterSpec:
    """Cumulative counters: what identifies a counter, what is counted, what is shown and how it is sorted."""

    keys: tuple[str, ...]
    counters: tuple[str, ...]
    sort_by: str
    ratios: tuple[Ratio, ...] = ()
    report_keys: tuple[str, ...] = field(default=())

    @property
    def shown_keys(self) -> tuple[str, ...]:
        """The keys of the report: all of them, or fewer when detail is summed up."""
        return self.report_keys or self.keys


_MS_PER_WAIT = Ratio("ms_per_wait", "time_waited_micro", "total_waits", 0.001)

# The nine counter sets, with their keys, counters and default sort column.
COUNTER_SETS = {
    "sysstat": CounterSpec(("inst_id", "name"), ("value",), "value"),
    "system_event": CounterSpec(
        ("inst_id", "event"), ("time_waited_micro", "total_waits"), "total_waits", (_MS_PER_WAIT,)
    ),
    "sess_event": CounterSpec(
        ("inst_id", "sql_id", "event", "sid", "serial_no"), ("time_waited_micro", "total_waits"), "total_waits",
        (_MS_PER_WAIT,), ("inst_id", "sql_id", "event"),
    ),
    "sess_stat": CounterSpec(
        ("inst_id", "sql_id", "name", "sid", "serial_no"), ("value",), "value", (), ("inst_id", "sql_id", "name")
    ),
    "event_histogram": CounterSpec(("inst_id", "event", "wait_time_milli"), ("wait_count",), "wait_count"),
    "sgastat": CounterSpec(("inst_id", "pool", "name"), ("bytes",), "bytes"),
    "librarycache": CounterSpec(
        ("inst_id", "namespace"), ("reloads", "invalidations", "gets", "gethits", "pins", "pinhits"), "gets",
        (Ratio("get_ratio", "gethits", "gets", 100.0), Ratio("pin_ratio", "pinhits", "pins", 100.0)),
    ),
    "segments_stats": CounterSpec(
        ("inst_id", "owner", "object_name", "statistic_name", "dataobj_id"), ("value",), "value"
    ),
    "enqueue_statistics": CounterSpec(
        ("inst_id", "eq_name", "eq_type", "req_reason"),
        ("total_req", "total_wait", "succ_req", "failed_req", "cum_wait_time"), "total_req",
    ),
}

# Upper bounds of the latency buckets in milliseconds; slower waits overflow.
LATENCY_BUCKETS = tuple(2**power for power in range(23))


@dataclass(frozen=True)
class Rule:
    """A readiness rule: an observed number must compare as told with a required one."""

    name: str
    comparison: str
    required: float


# Least versions by component type, and of the two layouts of a rack description.
MINIMUM_VERSIONS = {"cell": "11.2.2.3", "tool": "1.8.10.3", "switch": "1.1.3-2", "agent": "12.1.0.2.0"}
MINIMUM_SCHEMA = {"catalog": "868", "machine": "502"}


@dataclass(frozen=True)
class LeaderRule:
    """A log pattern that tells who leads: the logging node itself, or the captured name or number.

    ``needle`` is plain text that every matching line holds; it is looked for before the pattern is tried.
    """

    role: str
    needle: str
    pattern: str
    names: str


# What the logs say when a role gets a new leader.
LEADER_RULES = (
    LeaderRule("group", "clssgmCMReconfig", r"reconfiguration successful.*incarnation\s+.*master node (.*),", "name"),
    LeaderRule("registry", "I AM THE NEW OCR MASTER", r"I AM THE NEW OCR MASTER at incar", "self"),
    LeaderRule("registry", "NEW OCR MASTER IS", r"NEW OCR MASTER IS (\d+)", "id"),
    LeaderRule("policy", "PE MASTER NAME", r"CRSPE.*PE MASTER NAME:\s+(.*)", "name"),
    LeaderRule("standby", "I AM A STANDBY MASTER", r"I AM A STANDBY MASTER", "self"),
    LeaderRule("standby", "CURRENT STANDBY SERVERS", r"CURRENT STANDBY SERVERS:\s*(.*)", "name"),
    LeaderRule("time", "is the CTSS master", r"ctsselect_msccb\d: (.*) is the CTSS master$", "name"),
    LeaderRule("ui", "Master change notification", r"Master change notification has received. New master: (\d+)$", "id"),
    LeaderRule("notification", "ONSPROC", r"ONSPROC CssSemMM::tryMaster I am the master$", "self"),
    LeaderRule("net notification", "ONSNETPROC", r"ONSNETPROC CssSemMM::tryMaster I am the master$", "self"),
)

# Log patterns that name the hub a leaf is attached to, in the order they are trusted.
ATTACHMENT_PATTERNS = (
    r"clssbnmc_PeriodicPing_CB: Sending a ping msg to host (\S+), number \d+, using handle",
    r"clssscPipeConnect: Successfully connected to node with connection string gipcha://(\S+):",
    r"clssscPipeConnect: Initiated connect to node with connection string gipcha://(\S+):bcm_",
    r"clssgmSendEventsToClients: Group haip.rim.cluster_interconnect.(\S+), member count",
)
MEMBER_PATTERN = r"clssgmGetMemberAttr:grock #CSS_BCNG memnum (\d+) attrtype \d+ len \d+ value \((\d+)/"

# The rank line and the role and state line.
RANK_PATTERN = r"OCRMAS.*My Rank:\[(\d+)\]. Min Rank:\[(\d+)\]"
STATE_PATTERN = (
    r"CRSPE.+PE Role\|State Update: old role \[(.+)\] new \[(.+)\]; old state \[(.+)\] new \[(.+)\]$"
)
