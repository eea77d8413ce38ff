"""Rules given as tables: log patterns and least versions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.exprs import version_suffix
from tidemark.operators.skew import lookup_join

#: Bytes of rules that are sent to every executor at once.
MOST_RULE_BYTES = 16 << 20


def _matcher(rules: list[tuple[str, str, str]], line_at: int, names: list[str]):
    """The function for ``mapInArrow``. It is made here, so that it travels to the executors by value."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        needles: dict[str, list[int]] = {}
        for number, (_, needle, _) in enumerate(rules):
            needles.setdefault(needle, []).append(number)
        automaton = ahocorasick.Automaton()
        for needle, numbers in needles.items():
            if needle:
                automaton.add_word(needle, numbers)
        always, found_any = needles.get("", []), bool(len(automaton))
        if found_any:
            automaton.make_automaton()
        patterns: dict[int, re.Pattern] = {}
        for batch in batches:
            rows, kinds, groups = [], [], []
            for at, line in enumerate(batch.column(line_at).to_pylist()):
                if line is None:
                    continue
                tried = set(always)
                if found_any:
                    for _, numbers in automaton.iter(line):
                        tried.update(numbers)
                for number in sorted(tried):
                    if number not in patterns:
                        patterns[number] = re.compile(rules[number][2])
                    match = patterns[number].search(line)
                    if match:
                        rows.append(at)
                        kinds.append(rules[number][0])
                        groups.append([g if g is not None else "" for g in match.groups()])
            kept = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(kinds, pa.string()), pa.array(groups, pa.list_(pa.string()))], names=names)

    return run


def match_rules(lines: DataFrame, rules: DataFrame, line: str = "line") -> DataFrame:
    """Lines with the rules that they fit: all columns of ``lines`` and ``rule`` and ``groups``, one row per line and rule.

    ``rules`` has (rule, needle, pattern): every line that fits the pattern holds the needle, plain text. One pass of an
    automaton finds the needles of all rules in a line, and only the rules of those found try their patterns, so the work
    follows the rules that may fit and not their number. A rule without a needle (null or empty) is tried on every line.
    Patterns are Python's; a group that took no part is empty. Null lines fit nothing. Rules are sent to the executors
    in lots of at most ``MOST_RULE_BYTES``, each lot a pass; rules with a null name or pattern are left out.
    """
    kept = [c for c in lines.columns if c.lower() not in ("rule", "groups")]
    source = lines.select(*[F.col(f"`{c}`") for c in kept])
    added = [T.StructField("rule", T.StringType()), T.StructField("groups", T.ArrayType(T.StringType()))]
    schema = T.StructType([*source.schema.fields, *added])
    result, lot, held = None, [], 0

    def matched(part: list[tuple[str, str, str]]) -> DataFrame:
        found = source.mapInArrow(_matcher(part, kept.index(line), schema.names), schema)
        return found if result is None else result.unionByName(found)

    asked = rules.filter("rule IS NOT NULL AND pattern IS NOT NULL").select("rule", F.coalesce("needle", F.lit("")).alias("needle"), "pattern")
    for row in asked.distinct().toLocalIterator():
        size = sum(len(cell.encode()) for cell in row)
        if lot and held + size > MOST_RULE_BYTES:
            result, lot, held = matched(lot), [], 0
        lot.append(tuple(row))
        held += size
    return matched(lot) if lot or result is None else result


def version_key(version: Column) -> Column:
    """A text whose order is that of versions: every number of the dotted part padded, then the suffix.

    A shorter version sorts before a longer one that begins with it; a part that is no number sorts before any number.
    """
    numbers = F.transform(
        F.split(F.substring_index(version, "-", 1), "[.]"),
        lambda part: F.coalesce(F.lpad(part.try_cast("int").cast("string"), 10, "0"), F.lit("")),
    )
    return F.concat(F.array_join(numbers, "."), F.lit(" "), F.coalesce(version_suffix(version), F.lit("")))


def version_audit(versions: DataFrame, rules: DataFrame) -> DataFrame:
    """Whether each component has at least the version that ``rules`` (type, required) asks of its type.

    Types without a rule are left out; a missing version does not pass. Of several rules of a type all must pass, so
    the greatest counts.
    """
    least = rules.filter("required IS NOT NULL").groupBy("type").agg(F.max_by("required", version_key(F.col("required"))).alias("required"))
    ruled = lookup_join(versions, least, ["type"], "inner")
    passed = F.coalesce(version_key(F.col("version")) >= version_key(F.col("required")), F.lit(False))
    return ruled.withColumn("passed", passed)
