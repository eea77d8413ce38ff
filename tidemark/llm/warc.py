"""Web archives in WARC 1.1 and a globally ordered capture index.

Writing: each row becomes one record. Of the rows with equal payloads the one with the smallest id is a response, the others are
revisit records that refer to it. The files are written by Spark's text writer, so they may lie in any store it reaches.

Index: each archive gives one run of captures, sorted by URL key and time. The key space is cut into ranges that hold about
equally many captures, and in each range the runs are merged by a loser tree. Ranges in order, and captures in order
within them, are the global order; a URL with very many captures is cut by time like any other stretch.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.batches import column, hot_join, hot_keys
from tidemark.session import work_folder

#: Records in one archive at most, and captures in one range of the merge, about.
ARCHIVE_RECORDS, RANGE_ROWS = 10_000, 50_000
_END = "\r\n\r\n"
#: Fixed value of the format: the profile of revisits to an equal payload.
_SAME = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: four groups of forty bits are eight digits each."""
    hexed = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(page: Column, digest: Column) -> Column:
    mark = F.md5(F.concat_ws("|", F.coalesce(page.cast("string"), F.lit("")), digest).cast("binary"))
    parts = [F.substring(mark, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def with_record_types(df: DataFrame, key: str, payload: str) -> DataFrame:
    """(page, payload, size, digest, first): ``first`` is the smallest id with an equal payload; null payloads are empty."""
    rows = df.select(column(key).alias("page"), F.coalesce(column(payload), F.lit("")).alias("payload"), *[column(c).alias(c) for c in df.columns if c not in (key, payload)])
    raw = F.col("payload").cast("binary")
    rows = rows.withColumns({"size": F.octet_length("payload").cast("bigint"), "digest": base32_sha1(raw), "same": F.sha2(raw, 256)})
    counted = rows.groupBy("same").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n"))
    hot = hot_keys(counted, "same", "n", df.count())
    return hot_join(rows, counted.select("same", "first"), "same", hot, "page")


def write_archives(
    df: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html",
    captured: Column | None = None, compression: str = "gzip", records: int = ARCHIVE_RECORDS,
) -> None:
    """Writes one record for every row of ``df`` to archives in ``folder``.

    ``captured`` is the time of capture; by default it is drawn from the id. A null payload is empty, a null URL is left out of the
    record, line breaks in a URL are escaped. A null id gives a record without one; if all rows of a payload have
    none, each is a response. Rows that repeat the smallest id are responses too. Offsets count in the unpacked archive.
    """
    when = captured if captured is not None else F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(F.coalesce(column(key), F.lit(0)), F.lit(31_536_000)))
    rows = with_record_types(df.select(column(key), column(payload), column(url).alias("target"), when.alias("at")), key, payload)
    first = F.col("page").eqNullSafe(F.col("first"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    target = F.regexp_replace(F.regexp_replace(F.col("target"), "\r", "%0D"), "\n", "%0A")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(_END))
    block = F.when(first, F.concat(http, F.col("payload"))).otherwise(http)
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(first, "response").otherwise("revisit")),
        line("WARC-Record-ID", _record_id(F.col("page"), F.col("digest"))),
        line("WARC-Date", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line("WARC-Target-URI", target),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("X-Page-ID", F.col("page").cast("string")),
        line("WARC-Refers-To", F.when(~first, _record_id(F.col("first"), F.col("digest")))),
        line("X-Refers-To-Page-ID", F.when(~first, F.col("first").cast("string"))),
        line("WARC-Profile", F.when(~first, F.lit(_SAME))),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.octet_length(http) + F.when(first, F.col("size")).otherwise(0)).cast("string"),
        F.lit(_END),
        block,
    )
    rows.select(record.alias("value")).write.option("lineSep", _END).option("maxRecordsPerFile", records).option("compression", compression).text(folder)


def records_of(archive: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers in lower case, block) of every record, found by the lengths the records state."""
    at = 0
    while at < len(archive):
        head = archive.index(b"\r\n\r\n", at)
        lines = archive[at:head].decode("utf-8", "replace").split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at {at}")
        headers = {name.lower(): value for name, _, value in (line.partition(": ") for line in lines[1:])}
        size = int(headers["content-length"])
        block = archive[head + 4 : head + 4 + size]
        end = head + 4 + size + 4
        if len(block) < size or archive[end - 4 : end] != b"\r\n\r\n":
            raise ValueError(f"record at {at} is cut off")
        yield at, end - at, headers, block
        at = end


def url_key(url: str) -> str:
    """Sortable key of a URL: host names reversed, then the path; scheme, user, port and a leading www go."""
    found = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)(?::\d*)?([^#]*)", url)
    if not found:
        return url.lower()
    host = re.sub(r"^www\d*\.", "", found[1].lower())
    return ",".join(reversed(host.split("."))) + ")" + (found[2] or "/").lower()


_FIELDS = (
    "url_key string, captured string, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
    "archive string, record_offset bigint, record_bytes bigint"
)
_KINDS = [("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("record_offset", pa.int64()), ("record_bytes", pa.int64())]


def _capture(archive: str, offset: int, length: int, headers: dict[str, str], block: bytes) -> tuple:
    number = lambda name: int(headers[name]) if name in headers else None
    http, _, body = block.partition(b"\r\n\r\n")
    stated = int(re.search(rb"(?im)^content-length: (\d+)", http)[1])
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    if headers["warc-type"] == "response" and (len(body) != stated or base64.b32encode(hashlib.sha1(body).digest()).decode() != digest):
        raise ValueError(f"{archive} at {offset}: the payload is not what its record states")
    return (url_key(headers.get("warc-target-uri", "")), headers["warc-date"], number("x-page-id"), stated, digest, headers["warc-type"], number("x-refers-to-page-id"), archive, offset, length)


def _order(capture: tuple) -> tuple:
    """Place of a capture in the index: key, time, id (none first), then where it lies."""
    return (capture[0], capture[1], -1 if capture[2] is None else capture[2], capture[7], capture[8])


def read_captures(spark: SparkSession, folder: str) -> DataFrame:
    """Captures of all archives in ``folder``, each archive a run sorted by URL key and time; payloads are checked."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_py()
                name = path.rsplit("/", 1)[-1]
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                captures = sorted((_capture(name, *record) for record in records_of(data)), key=_order)
                yield pa.RecordBatch.from_arrays([pa.array([c[k] for c in captures], kind) for k, (_, kind) in enumerate(_KINDS)], names=[n for n, _ in _KINDS])

    return files.mapInArrow(run, _FIELDS)


def loser_tree(runs: list[list], order: Callable) -> Iterator:
    """Merges sorted runs. Inner nodes hold the losers of their matches, so each step replays one path to the root."""
    size = len(runs)
    if not size:
        return
    at = [0] * size
    ended = (1,)
    keys = [(0, order(run[0])) if run else ended for run in runs]
    tree = [-1] * size
    for run in range(size):  # seat the runs one by one
        node, winner = (run + size) // 2, run
        while node > 0:
            if tree[node] < 0:
                tree[node], winner = winner, -1
                break
            if keys[tree[node]] < keys[winner]:
                tree[node], winner = winner, tree[node]
            node //= 2
        if winner >= 0:
            tree[0] = winner
    while keys[tree[0]] != ended:
        run = tree[0]
        yield runs[run][at[run]]
        at[run] += 1
        keys[run] = (0, order(runs[run][at[run]])) if at[run] < len(runs[run]) else ended
        node, winner = (run + size) // 2, run
        while node > 0:
            if keys[tree[node]] < keys[winner]:
                tree[node], winner = winner, tree[node]
            node //= 2
        tree[0] = winner


def merge_index(captures: DataFrame, rows: int | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Captures in global order: ``range`` and ``place`` in it are added, and ``previous``, the id of the capture of the same URL before.

    ``captures`` holds one sorted run for each archive. ``previous`` looks back within a range.
    """
    total = captures.count() if rows is None else rows
    ranges = captures.repartitionByRange(max(1, -(-total // range_rows)), "url_key", "captured", "page_id", "archive", "record_offset")
    runs = ranges.sortWithinPartitions("archive", "url_key", "captured", F.asc_nulls_first("page_id"), "record_offset").withColumn("range", F.spark_partition_id())
    names = [n for n, _ in _KINDS]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple]] = {}
        number = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(row[7], []).append(row[:-1])
                number = row[-1]
        merged = list(loser_tree(list(held.values()), _order))
        before, previous = None, []
        for capture in merged:
            previous.append(before[2] if before and before[0] == capture[0] else None)
            before = capture
        columns = [pa.array([c[k] for c in merged], kind) for k, (_, kind) in enumerate(_KINDS)]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array([number] * len(merged), pa.int32()), pa.array(range(len(merged)), pa.int64()), pa.array(previous, pa.int64())],
            names=[*names, "range", "place", "previous"],
        )

    return runs.mapInArrow(run, f"{_FIELDS}, range int, place bigint, previous bigint")


def archived_captures(df: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Writes ``df`` to archives in the shared folder, reads them back and returns the ordered capture index.

    A table without rows gives an empty index. Columns other than the three named are not read.
    """
    spark = df.sparkSession
    folder, index = work_folder(spark, "archives"), work_folder(spark, "runs")
    write_archives(df, folder, key, url, payload)
    read_captures(spark, folder).write.parquet(index)
    return merge_index(spark.read.schema(_FIELDS).parquet(index))
