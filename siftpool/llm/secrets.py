"""Secret scans with structural confirmation.

Three base patterns are reported as they match. Further candidates, base64,
hex or dotted, are decoded and reported only if the bytes parse: private keys
as DER with every nested length filling its parent, OpenSSH keys by their
length-prefixed fields, signed tokens by a JSON header that names an algorithm.
How much of a DER candidate belongs to it is told by its own outer length, so
base64 that is wrapped over lines is found without a frame around it.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: All kinds, in the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "derhex", "ssh", "pembase64")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Three dotted parts, the first one such that its first byte is a brace or white space.
_JWT = re.compile(r"(?<![A-Za-z0-9_-])((?:e[w-z0-9_-]|I[A-P]|C[Q-Za-v]|D[Q-Za-f])[A-Za-z0-9_-]{10,})\.[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:[A-Za-z0-9+/=\s]|\\[nrt])*?)-----END \1-----")
#: Line ends as source code and JSON write them.
_ESCAPED = re.compile(r"\\[nrt]")
_DER = re.compile(r"(?<![A-Za-z0-9+/_-])M[A-Za-z0-9+/_-]{19,}")
_DERHEX = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{46,}")
_SSH = re.compile(r"(?<![A-Za-z0-9+/])b3BlbnNzaC1rZXktdjE[A-Za-z0-9+/]+")
#: Base64 of what begins as a frame does.
_FRAMED = re.compile(r"(?<![A-Za-z0-9+/_-])LS0tLS1CRUdJTi[A-Za-z0-9+/_-]+")
#: A line's end inside wrapped base64, and the letters that follow.
_WRAP = re.compile(r"(?:[ \t]*(?:\r?\n|\\r\\n|\\n)[ \t]*)([A-Za-z0-9+/_-]+)")
_SSH_MAGIC = b"openssh-key-v1\0"


def base64_bytes(text: str) -> bytes | None:
    """Decoded base64 in either alphabet, with or without padding, white space ignored; None if it is none."""
    body = "".join(text.split()).rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the elements that fill data exactly, or None."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            size = int.from_bytes(data[at : at + n], "big")
            if size < 0x80 or (n > 1 and size < 1 << 8 * (n - 1)):  # DER has the shortest form only
                return None
            at += n
        if at + size > len(data):
            return None
        out.append((tag, data[at : at + size]))
        at += size
    return out


def is_private_key(data: bytes) -> bool:
    """PKCS#1, SEC 1, PKCS#8 (plain or encrypted) or DSA private key in DER, nested lengths included."""
    top = der_items(data)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    items = der_items(top[0][1])
    if not items:
        return False
    tags = [t for t, _ in items]
    first = items[0][1]
    if tags[0] == 0x02 and len(first) == 1:
        if len(tags) in (6, 9, 10) and tags[:6] == [2] * 6:  # DSA has six numbers, RSA nine
            return all(v for _, v in items)
        if first == b"\1" and tags[1:2] == [0x04]:
            return len(items[1][1]) in range(16, 73) and all(t in (0xA0, 0xA1) and der_items(v) for t, v in items[2:])
        if first in (b"\0", b"\1") and tags[1:3] == [0x30, 0x04]:
            algorithm = der_items(items[1][1])
            return bool(algorithm) and algorithm[0][0] == 0x06 and bool(der_items(items[2][1]) or len(items[2][1]) >= 32)
    if tags == [0x30, 0x04]:
        algorithm = der_items(first)
        return bool(algorithm) and algorithm[0][0] == 0x06 and len(algorithm) == 2 and bool(der_items(algorithm[1][1])) and len(items[1][1]) >= 32
    return False


def is_ssh_key(data: bytes) -> bool:
    """An openssh-key-v1 container whose length-prefixed fields fit."""
    if not data.startswith(_SSH_MAGIC):
        return False
    at, fields, seen = len(_SSH_MAGIC), 4, 0  # cipher, kdf, its options, the number of keys; then the keys and the private part
    while seen < fields:
        if at + 4 > len(data):
            return False
        size = int.from_bytes(data[at : at + 4], "big")
        at += 4
        seen += 1
        if seen == 4:
            if not size:
                return False
            fields += size + 1  # each of them takes four bytes of data at least
            continue
        if at + size > len(data):
            return False
        at += size
    return True


def wrapped(text: str, first: re.Match, letters: float) -> tuple[str, int]:
    """Base64 letters from the match on, over line ends, as many as wanted if there are so many; and the place after the last."""
    parts, end, n = [first[0]], first.end(), len(first[0])
    while n < letters and (m := _WRAP.match(text, end)):
        parts.append(m[1])
        n, end = n + len(m[1]), m.end()
    return "".join(parts), end


def der_span(text: str, first: re.Match) -> int | None:
    """The place after a DER private key in base64 that begins at the match, padding included; None if there is none."""
    head = base64_bytes(first[0][:12])
    if not head or head[0] != 0x30:
        return None
    size, extra = head[1], 0
    if size & 0x80:
        extra = size & 0x7F
        if not 1 <= extra <= 4:
            return None
        size = int.from_bytes(head[2 : 2 + extra], "big")
    letters = -(-(2 + extra + size) * 8 // 6)
    body, end = wrapped(text, first, letters)
    if len(body) != letters:
        return None
    data = base64_bytes(body)
    if not data or not is_private_key(data):
        return None
    while end < len(text) and text[end] == "=":
        end += 1
    return end


def is_header(part: str) -> bool:
    """The header of a signed token: base64 of a JSON object with a text "alg". The payload may be anything, or left out."""
    try:
        head = json.loads(base64_bytes(part) or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str)


def tokens(text: str) -> Iterator[tuple[int, int]]:
    """Spans of signed tokens; where a part is no header, the search goes on behind it."""
    at = 0
    while m := _JWT.search(text, at):
        at = m.end(1)
        if is_header(m[1]):
            at = m.end()
            yield m.start(), at


def frames(text: str) -> Iterator[tuple[int, int]]:
    """Spans of framed private keys, as text or with escaped line ends."""
    for m in _PEM.finditer(text):
        data = base64_bytes(_ESCAPED.sub("", m[2]))
        if data and (is_private_key(data) or is_ssh_key(data)):
            yield m.span()


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all spans, sorted; places are code points, ends exclusive."""
    out = []
    if ":" in text or "=" in text:
        low = text.lower()
        if any(w in low for w in _WORDS):
            out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    out += [(a, 3, b) for a, b in tokens(text)]
    if "-----BEGIN" in text:
        out += [(a, 4, b) for a, b in frames(text)]
    out += [(m.start(), 5, end) for m in _DER.finditer(text) if (end := der_span(text, m))]
    out += [(m.start(), 6, m.end()) for m in _DERHEX.finditer(text) if len(m[0]) % 2 == 0 and is_private_key(bytes.fromhex(m[0]))]
    if "b3BlbnNzaC1rZXktdjE" in text:
        for m in _SSH.finditer(text):
            body, end = wrapped(text, m, math.inf)
            if (d := base64_bytes(body[: len(body) // 4 * 4] if len(body) % 4 == 1 else body)) and is_ssh_key(d):
                out.append((m.start(), 7, end + len(text[end : end + 2]) - len(text[end : end + 2].lstrip("="))))
    if "LS0tLS1CRUdJTi" in text:
        for m in _FRAMED.finditer(text):
            body, end = wrapped(text, m, math.inf)
            if any(True for _ in frames((base64_bytes(body) or b"").decode("latin-1"))):
                out.append((m.start(), 8, end + len(text[end : end + 2]) - len(text[end : end + 2].lstrip("="))))
    return sorted(out)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) for each row of docs.

    Base spans are leftmost and non-overlapping within a kind: assign (a value of
    six characters or more), access (20 or more), hex (24 or more). spans lists
    kind:start:end of all spans, joined by commas, by start and then kind;
    base_sha256 is the digest of that list for base kinds alone. Null is the
    empty text, without spans. Null and repeated ids are rows as any others; an
    empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [[], [], []]
            shas, spans = [], []
            for text in b[1]:
                found = scan(text.as_py() or "")
                told = [(k, f"{KINDS[k]}:{s}:{e}") for s, k, e in found]
                for k in range(3):
                    counts[k].append(sum(x == k for x, _ in told))
                shas.append(hashlib.sha256(",".join(t for k, t in told if k < 3).encode()).hexdigest())
                spans.append(",".join(t for _, t in told))
            yield pa.RecordBatch.from_arrays([b[0], *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(spans, pa.string())], ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(run, f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return found.withColumnRenamed("id", id_col)
