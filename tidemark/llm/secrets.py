"""Secret scans with structural confirmation.

Three plain kinds are found by pattern. Further kinds are reported only when their content parses: a base64 or hex run
must decode to a private key whose nested lengths add up, a token must have a JSON header that names a signature.

Keys are found as they stand in files, mail and code: in a line or wrapped over several, with or without head and foot lines, in a
JSON string whose line ends are written as two characters, quoted or commented at the begin of lines, as the end of a path,
packed once more as a whole, and as hexadecimal digits with or without colons. The outer length of a key says where it ends.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.batches import add_columns, sha256, texts_of

#: The base kinds in their order, then the confirmed ones.
BASE_KINDS = ("assign", "access", "hex")
CONFIRMED_KINDS = ("pem", "key", "jwt")
KINDS = BASE_KINDS + CONFIRMED_KINDS

_ASSIGN = re.compile(
    r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
    r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Long runs in which a structure may hide; none of the patterns below can match without one.
_LONG = re.compile(r"[A-Za-z0-9+/_.=-]{20,}")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?)-----((?:(?!-----)[\s\S])*)-----END \1-----")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{44,}={0,2}")
#: What quotes or comments a line, and a base64 text over several lines.
_HEADS = " \t>|#*;"
_LINES = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}(?:\r?\x20?\n[\x20\t>|#*;]*[A-Za-z0-9+/]+)+={0,2}")
_HEX_RUN = re.compile(r"[0-9A-Fa-f]{64,}")
_COLONS = re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{2}(?::\s{0,80}[0-9A-Fa-f]{2}){31,}")
#: Where a key can begin in a run: first letters of a DER sequence, of a shell key and of a head line, after a separator.
_MARK = re.compile(r"(?:^|(?<=[/+_-]))(?=M[A-Za-z0-9+/_-]{3}|b3BlbnNzaC1rZXkt|LS0tLS1CRUdJTi)")
#: Ciphers of keys with a password and the size of their blocks.
_CIPHERS = {"AES-128-CBC": 16, "AES-192-CBC": 16, "AES-256-CBC": 16, "DES-EDE3-CBC": 8, "DES-CBC": 8, "CAMELLIA-256-CBC": 16, "IDEA-CBC": 8}
_DEK = re.compile(r"DEK-Info:\s*([A-Z0-9-]+),\s*((?:[0-9A-Fa-f]{2}){8,})")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])ey[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")

_SEQUENCE, _INTEGER, _BITS, _OCTETS, _OID = 0x30, 0x02, 0x03, 0x04, 0x06


def decode64(run: str) -> bytes | None:
    """Bytes of a base64 run in either alphabet, padded or not; null if it is none."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def elements(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tag and content of each element in ``data`` if their lengths fill it exactly."""
    found, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size >= 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or at + width > len(data) or data[at] == 0:
                return None
            size, at = int.from_bytes(data[at : at + width], "big"), at + width
            if size < 0x80:
                return None
        if at + size > len(data):
            return None
        found.append((tag, data[at : at + size]))
        at += size
    return found


def is_der_key(data: bytes) -> bool:
    """A private key in DER: RSA or DSA (integers), EC, wrapped or encrypted."""
    if len(data) < 24 or data[0] != _SEQUENCE:
        return False
    outer = elements(data)
    if not outer or len(outer) != 1:
        return False
    parts = elements(outer[0][1])
    if not parts:
        return False
    tags = [tag for tag, _ in parts]
    if tags[0] == _INTEGER and parts[0][1] in (b"\0", b"\1"):
        if len(tags) >= 6 and all(tag == _INTEGER for tag in tags):
            return True
        if tags[1:2] == [_OCTETS] and parts[0][1] == b"\1":
            return len(parts[1][1]) >= 16
        if tags[1:3] == [_SEQUENCE, _OCTETS]:
            algorithm = elements(parts[1][1])
            return bool(algorithm) and algorithm[0][0] == _OID
    if tags == [_SEQUENCE, _OCTETS]:
        algorithm = elements(parts[0][1])
        return bool(algorithm) and algorithm[0][0] == _OID and len(parts[1][1]) >= 16
    return False


def is_shell_key(data: bytes) -> bool:
    """A private key in the format of secure shells: a magic word, then strings whose lengths fit each other."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)

    def string() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        value, at = data[at + 4 : at + 4 + size], at + 4 + size
        return value

    if any(string() is None for _ in range(3)):
        return False
    count, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    if not 1 <= count <= 16:
        return False
    for _ in range(count):
        public = string()
        if public is None or len(public) < 8 or int.from_bytes(public[:4], "big") > len(public) - 4:
            return False
    private = string()
    return private is not None and len(private) >= 8 and len(private) % 8 == 0


def is_key(data: bytes | None) -> bool:
    return data is not None and (is_der_key(data) or is_shell_key(data))


def is_pgp_key(data: bytes | None) -> bool:
    """A secret key packet of OpenPGP at the begin, whose length lies within the data."""
    if not data or len(data) < 8 or not data[0] & 0x80:
        return False
    if data[0] & 0x40:
        tag, first = data[0] & 0x3F, data[1]
        if first < 192:
            size, at = first, 2
        elif first < 224:
            size, at = ((first - 192) << 8) + data[2] + 192, 3
        elif first == 255:
            size, at = int.from_bytes(data[2:6], "big"), 6
        else:
            return False
    else:
        tag, width = (data[0] >> 2) & 0x0F, (1, 2, 4, 0)[data[0] & 3]
        size, at = int.from_bytes(data[1 : 1 + width], "big"), 1 + width
        if not width:
            return False
    return tag == 5 and size >= 16 and at + size <= len(data) and data[at] in (3, 4, 5, 6)


def der_size(head: bytes | None) -> int:
    """Bytes of the DER sequence that begins with ``head``, or 0."""
    if not head or len(head) < 6 or head[0] != _SEQUENCE:
        return 0
    if head[1] < 0x80:
        return head[1] + 2
    width = head[1] & 0x7F
    return int.from_bytes(head[2 : 2 + width], "big") + 2 + width if 1 <= width <= 4 else 0


def keys_in(run: str) -> list[tuple[int, int]]:
    """Start and end of the keys in a base64 run: at its begin or after a separator, up to where their length says."""
    found, done = [], 0
    for mark in _MARK.finditer(run):
        start, end = mark.start(), 0
        if start < done:
            continue
        if run[start] == "M":
            size = der_size(decode64(run[start : start + 8]))
            stop = start + -(-size * 4 // 3)
            # Not a letter further: what follows a key is padding, a separator or the end.
            if size and stop <= len(run) and run[stop : stop + 1] in ("", "=", "/", "-", "_", "+") and is_key(decode64(run[start:stop])):
                end = stop + len(run[stop : stop + 2]) - len(run[stop : stop + 2].lstrip("="))
        else:
            data = decode64(run[start:])
            whole = data is not None and data.startswith(b"-----BEGIN ") and pem_spans(data.decode("ascii", "replace"))
            end = len(run) if whole or is_key(data) else 0
        if end:
            found.append((start, end))
            done = end
    return found


def pem_spans(text: str) -> list[tuple[int, int]]:
    """Start and end of the blocks with head and foot lines that hold a private key."""
    found = []
    for m in _PEM.finditer(text):
        lines = [line.strip(_HEADS + "\r\"',") for line in m[2].split("\n")]
        body = "".join(line for line in lines if ":" not in line and not line.startswith("="))
        raw = decode64("".join(body.split()))
        locked = _DEK.search(m[2]) if "Proc-Type:" in m[2] else None
        block = _CIPHERS.get(locked[1].upper()) if locked else None
        if (is_pgp_key(raw) if m[1].endswith("BLOCK") else is_key(raw)) or (block and raw and len(raw) >= 64 and len(raw) % block == 0):
            found.append(m.span())
    return found


def line_spans(text: str) -> list[tuple[int, int]]:
    """Start and end of keys in base64 that is wrapped over lines without head and foot."""
    found = []
    for m in _LINES.finditer(text):
        places = [m.start() + k for k, c in enumerate(m[0]) if c.isalnum() or c in "+/="]
        run = "".join(text[k] for k in places)
        found += [(places[a], places[b - 1] + 1) for a, b in keys_in(run) if a == 0]
    return found


def hex_spans(text: str) -> list[tuple[int, int]]:
    """Start and end of keys in hexadecimal digits, which may have one digit before them, or a colon after each byte."""
    found = []
    for m in _HEX_RUN.finditer(text):
        for start in (0, 1):
            size = 2 * der_size(bytes.fromhex(m[0][start : start + 12]))
            if size and start + size <= len(m[0]) and is_key(bytes.fromhex(m[0][start : start + size])):
                found.append((m.start() + start, m.start() + start + size))
                break
    for m in _COLONS.finditer(text):
        data = bytes.fromhex("".join(m[0].replace(":", " ").split()))
        if is_key(data):
            found.append(m.span())
    return found


def is_signed_token(run: str) -> bool:
    """Three base64 parts: a JSON header with a signature algorithm, JSON claims, a signature."""
    header, claims, signature = run.split(".")
    decoded = []
    for part in (header, claims):
        raw = decode64(part)
        try:
            value = json.loads(raw) if raw is not None else None
        except (ValueError, RecursionError):
            return False
        if not isinstance(value, dict):
            return False
        decoded.append(value)
    named = decoded[0].get("alg")
    return isinstance(named, str) and named.lower() not in ("", "none") and bool(decode64(signature))


def spans(text: str) -> list[tuple[str, int, int]]:
    """All (kind, start, end) of a text in code points, by start, then kind as listed."""
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    # A line end that is written as two characters takes the place of both, so that spans stay where they are.
    plain = text.replace("\\r", "\r ").replace("\\n", "\n ") if "\\n" in text else text
    blocks = pem_spans(plain) if "-----BEGIN " in text else []
    found += [("pem", *span) for span in blocks]
    if _LONG.search(text):
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
        found += [("hex", *m.span()) for m in _HEX.finditer(text)]
        found += [("jwt", *m.span()) for m in _TOKEN.finditer(text) if is_signed_token(m[0])]
        keys = [(m.start() + a, m.start() + b) for m in _RUN.finditer(plain) for a, b in keys_in(m[0])]
        keys += line_spans(plain) + hex_spans(text)
        found += [("key", a, b) for a, b in keys if not any(x <= a and b <= y for x, y in blocks)]
    elif ":" in text:
        found += [("key", *span) for span in hex_spans(text)]
    rank = {kind: k for k, kind in enumerate(KINDS)}
    return sorted(set(found), key=lambda s: (s[1], rank[s[0]], s[2]))


def written(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in found)


def masked(text: str, found: list[tuple[str, int, int]], mask: str) -> str:
    """``text`` with every span, or run of overlapping spans, replaced by ``mask``."""
    pieces, at = [], 0
    for _, start, end in sorted(found, key=lambda s: s[1:]):
        if start >= at:
            pieces += [text[at:start], mask]
        at = max(at, end)
    return "".join([*pieces, text[at:]])


def scan_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``secrets``, an array of (kind, start, end) in code points, for each row of ``df``.

    A null text counts as empty and has no spans. Every occurrence is reported, repeated rows each on their own; a
    table without rows stays empty. Only ``text`` is read; other columns pass through, and one called ``secrets``
    is replaced.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def compute(column: pa.Array) -> list[pa.Array]:
        rows = [[{"kind": k, "start": a, "end": b} for k, a, b in spans(t)] for t in texts_of(column)]
        return [pa.array(rows, kind)]

    return add_columns(
        df, text, "secrets array<struct<kind:string,start:bigint,end:bigint>>", compute
    )


def secret_digest(df: DataFrame, text: str = "text") -> DataFrame:
    """``scan_secrets`` reduced to counts, the hash of the base spans and all spans written out; drops the text."""

    def compute(column: pa.Array) -> list[pa.Array]:
        rows = [spans(t) for t in texts_of(column)]
        base = [[s for s in row if s[0] in BASE_KINDS] for row in rows]
        counts = [pa.array([sum(s[0] == kind for s in row) for row in rows], pa.int64()) for kind in BASE_KINDS]
        return [*counts, pa.array([sha256(written(row)) for row in base]), pa.array([written(row) for row in rows])]

    return add_columns(
        df, text, "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string", compute, keep_text=False
    )


def redact_secrets(df: DataFrame, text: str = "text", mask: str = "[removed]") -> DataFrame:
    """``df`` with every secret in ``text`` replaced by ``mask``; rows, nulls and other columns stay as they are."""
    fields = df.schema
    names = df.columns
    at = names.index(text)

    def run(batches):
        for batch in batches:
            old = batch.column(at).to_pylist()
            new = [t if t is None or not (found := spans(t)) else masked(t, found, mask) for t in old]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.mapInArrow(run, fields)
