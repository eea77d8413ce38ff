"""Text that tools and logs leave behind, as tables. Lines come as ``(…, line_no, line)``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.operators.skew import with_running_total


def key_value(line: Column) -> tuple[Column, Column]:
    """Trimmed key and value of a ``Key: value`` line; both null for another line."""
    halves = F.split(line, ": ", 2)
    fits = F.size(halves) == 2
    return F.when(fits, F.trim(halves.getItem(0))), F.when(fits, F.trim(halves.getItem(1)))


def parse_kv_status(lines: DataFrame, fields: Mapping[str, Sequence[str]], keys: Sequence[str] = ("host",)) -> DataFrame:
    """One row per ``keys`` with a column per field; of a field's spellings the first non-empty one counts."""
    key, value = key_value(F.col("line"))
    pairs = lines.select(*keys, "line_no", key.alias("_k"), value.alias("_v")).filter("_v <> ''")

    def pick(spellings: Sequence[str]) -> Column:
        found = [
            F.min_by(F.when(F.col("_k") == s, F.col("_v")), F.when(F.col("_k") == s, F.col("line_no")))
            for s in spellings
        ]
        return F.coalesce(*found)

    return pairs.groupBy(*keys).agg(*[pick(spellings).alias(name) for name, spellings in fields.items()])


# Fields of a replication status in their new and old spelling.
REPLICA_FIELDS = {
    "io_running": ("Replica_IO_Running", "Slave_IO_Running"),
    "sql_running": ("Replica_SQL_Running", "Slave_SQL_Running"),
    "seconds_behind": ("Seconds_Behind_Source", "Seconds_Behind_Master"),
    "last_error": ("Last_SQL_Error", "Last_IO_Error", "Last_Error"),
}


def parse_param_lines(lines: DataFrame) -> DataFrame:
    """Hosts by component type from a parameter file: ``EM_CELLS=(a b c)`` and ``<device>…name=x`` lines."""
    line = F.col("line")
    listed = F.regexp_extract(line, "^EM_CELLS=(.*)$", 1)
    cells = F.filter(F.split(F.trim(F.regexp_replace(listed, "[()]", " ")), "[ \t]+"), lambda h: h != "")
    named = F.trim(F.regexp_extract(line, "^(?:swiib|swikvm|pdu).*name=(.*)$", 1))
    kind = F.when(line.startswith("EM_CELLS="), "cell").when(line.startswith("swiib"), "switch").when(
        line.startswith("swikvm"), "kvm").when(line.startswith("pdu"), "pdu")
    hosts = F.when(line.startswith("EM_CELLS="), cells).when(named != "", F.array(named))
    keys = [c for c in lines.columns if c not in ("line",)]
    return lines.select(*keys, kind.alias("component_type"), F.explode(hosts).alias("host"))


def with_stamp(lines: DataFrame) -> DataFrame:
    """Adds the first time stamp of each line as ``logged_at``."""
    stamp = F.regexp_extract("line", r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d{1,6})?)", 1)
    return lines.withColumn("logged_at", F.nullif(stamp, F.lit("")).try_cast("timestamp_ntz"))


def scan_log(lines: DataFrame, pattern: str) -> DataFrame:
    """Lines that fit ``pattern``, with their time stamp."""
    return with_stamp(lines.filter(F.col("line").rlike(pattern)))


def parse_whitespace_table(lines: DataFrame, pattern: str, columns: Sequence[str]) -> DataFrame:
    """One column per group of ``pattern``; a line that does not fit goes whole into ``rejected``."""
    line = F.col("line")
    fits = line.rlike(pattern)
    groups = [
        F.when(fits, F.regexp_extract(line, pattern, i + 1)).alias(name) for i, name in enumerate(columns)
    ]
    keys = [c for c in lines.columns if c != "line"]
    return lines.select(*keys, *groups, F.when(~fits, line).alias("rejected"))


def parse_block_records(
    lines: DataFrame, keys: Sequence[str], fields: Mapping[str, str], lines_per_chunk: int = 10000
) -> DataFrame:
    """One row per stanza; stanzas are parted by blank lines and hold ``KEY=value`` or ``Key: value`` lines.

    ``fields`` maps keys to column names. ``rejected`` is true when a stanza lacks one of them.
    """
    blank = F.when(F.trim("line") == "", 1).otherwise(0)
    chunk = F.floor(F.col("line_no") / lines_per_chunk)
    numbered = with_running_total(lines, keys, ["line_no"], blank, chunk, "record_no")
    split = F.regexp_extract("line", r"^([^=:]+)(?:=|: )(.*)$", 1)
    value = F.regexp_extract("line", r"^([^=:]+)(?:=|: )(.*)$", 2)
    pairs = numbered.withColumn("_k", F.upper(F.trim(split))).withColumn("_v", value).filter("_k <> ''")
    cells = [
        F.min_by(F.when(F.col("_k") == key.upper(), F.col("_v")), F.when(F.col("_k") == key.upper(), F.col("line_no")))
        .alias(column)
        for key, column in fields.items()
    ]
    rows = pairs.groupBy(*keys, "record_no").agg(*cells)
    missing = F.lit(False)
    for column in fields.values():
        missing = missing | F.col(column).isNull()
    return rows.withColumn("rejected", missing)


def parse_parallel_lists(lines: DataFrame, keys: Sequence[str], patterns: Mapping[str, str], order: str = "line_no") -> DataFrame:
    """One row per member of attribute lists that run side by side: the first match of each pattern belongs together,
    then the second, and so on.

    ``patterns`` maps columns to patterns with one group; their lines may stand anywhere among the others. ``member``
    counts from 1. ``rejected`` is true for all rows of a key whose lists differ in length. The output of one command
    is a short text, so a key is windowed whole.
    """
    line = F.col("line")
    kind = F.lit(None).cast("string")
    value = F.lit(None).cast("string")
    for column, pattern in reversed(patterns.items()):
        kind = F.when(line.rlike(pattern), F.lit(column)).otherwise(kind)
        value = F.when(line.rlike(pattern), F.regexp_extract(line, pattern, 1)).otherwise(value)
    found = lines.select(*keys, order, kind.alias("_kind"), value.alias("_value")).filter("_kind IS NOT NULL")
    numbered = found.withColumn("member", F.row_number().over(Window.partitionBy(*keys, "_kind").orderBy(order)))
    cells = [F.max(F.when(F.col("_kind") == c, F.col("_value"))).alias(c) for c in patterns]
    rows = numbered.groupBy(*keys, "member").agg(*cells, F.count("*").alias("_cells"))
    whole = F.min("_cells").over(Window.partitionBy(*keys)) == len(patterns)
    return rows.withColumn("rejected", ~whole).drop("_cells")


# Elements that begin a new line, and those whose content is no text.
BLOCKS = ("br", "p", "div", "li", "ul", "tr", "table", "h[1-6]", "title", "article", "nav")
RAW = ("script", "style")

#: What stands in a tag up to its end: quoted values may hold a closing bracket, a quote without its other half does not matter.
ATTRIBUTES = r"""(?:[^>=]|=\s*"[^"]*"|=\s*'[^']*'|=)*"""
_POSSESSIVE = r"""(?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+"""


def _code_point(number: Column) -> Column:
    """The character of a code point; what is none is the replacement character."""
    # Numbers 128 to 159 mean what they do in the Windows code page.
    windows = {n: bytes([n]).decode("cp1252", "replace") for n in range(128, 160)}
    moved = F.create_map(*[F.lit(x) for n, char in windows.items() for x in (n, char)])
    valid = (number > 0) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    return F.when(~valid, F.lit("\ufffd")).when(number.between(128, 159), F.try_element_at(moved, number.cast("int"))).otherwise(char)


def unescaped(text: Column) -> Column:
    """Character references as the characters they stand for: all numbers, and the names of HTML 4 with a semicolon.

    What is no such reference, an ampersand alone among them, stays as it is. Nothing is unescaped twice.
    """
    names = F.create_map(*[F.lit(x) for name, code in sorted({**name2codepoint, "apos": 39}.items()) for x in (name, chr(code))])
    reference = "^(?:#[xX]([0-9a-fA-F]{1,8});?|#([0-9]{1,9});?|([a-zA-Z][a-zA-Z0-9]*);)"

    def part(piece: Column) -> Column:
        whole = F.regexp_extract(piece, reference, 0)
        hexed, number, name = (F.regexp_extract(piece, reference, k) for k in (1, 2, 3))
        code = F.when(hexed != "", F.conv(hexed, 16, 10).cast("bigint")).when(number != "", number.cast("bigint"))
        char = F.when(code.isNotNull(), _code_point(code)).otherwise(F.try_element_at(names, name))
        return F.when((whole != "") & char.isNotNull(), F.concat(char, F.substr(piece, F.length(whole) + 1))).otherwise(F.concat(F.lit("&"), piece))

    pieces = F.split(text, "&")
    rest = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), part)
    return F.when(F.instr(text, "&") == 0, text).otherwise(F.concat(F.get(pieces, F.lit(0)), F.array_join(rest, "")))


def html_to_text(html: Column) -> Column:
    """Readable text of a saved page, one block element per line, without ``file:`` lines and blank lines.

    Comments, declarations and the content of scripts and styles go, tags end at the first bracket outside a quoted value, a
    bracket that begins no tag is text, and character references are replaced last.
    """
    raw = "|".join(rf"<{name}\b{_POSSESSIVE}>.*?</{name}\s*>" for name in RAW)
    text = F.regexp_replace(html, f"(?is)<!--.*?-->|{raw}|<[!?][^>]*>", "")
    text = F.regexp_replace(text, rf"(?i)</?(?:{'|'.join(BLOCKS)})(?=[\s/>]){_POSSESSIVE}>", "\n")
    text = F.regexp_replace(text, f"</?[a-zA-Z]{_POSSESSIVE}>", "")
    lines = F.split(F.regexp_replace(unescaped(text), "[ \t\r\u00a0]+", " "), "\n")
    kept = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda line: (line != "") & ~line.startswith("file:"))
    return F.array_join(kept, "\n")
