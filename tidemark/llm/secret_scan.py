"""Secret scans: fixed patterns, and candidates confirmed by the structure of what they encode."""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import with_batches

#: Kinds in the order in which spans of the same start are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "pem", "der", "ssh", "jwt")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # the same as AKIA[A-Z0-9]+ held to 20 characters or more
HEX = re.compile(r"[0-9a-f]{24,}")
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]{1,16} ){0,3}PRIVATE KEY)-----((?:\s*[A-Za-z-]+: [^\n]*\n)*)([A-Za-z0-9+/=\s\\]+)-----END \1-----")
#: A run begins where no sign of the alphabet stands before it, so that long runs are read once.
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]*+")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
LONG_HEX = re.compile(r"[0-9A-Fa-f]{40,}")
OPENSSH = b"openssh-key-v1\0"


def unbase64(text: str) -> bytes | None:
    """Decoded bytes of either alphabet, with or without padding; None if it cannot be base64."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the values that lie one after another in data; None unless their lengths fill it."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            wide = size & 0x7F
            if not 1 <= wide <= 4 or at + wide > len(data):
                return None
            size, at = int.from_bytes(data[at : at + wide], "big"), at + wide
        if at + size > len(data):
            return None
        out.append((tag, data[at : at + size]))
        at += size
    return out


INTEGER, OCTETS, OID, SEQUENCE = 0x02, 0x04, 0x06, 0x30
#: Arcs of password-based encryption (PKCS#5 and PKCS#12) as DER holds them.
ENCRYPTION = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def private_der(data: bytes) -> bool:
    """True for one DER value that is a private key: PKCS#1, DSA, SEC1, PKCS#8 or encrypted PKCS#8.

    Public keys, certificates and signatures are other sequences.
    """
    if len(data) < 16 or data[0] != SEQUENCE:
        return False
    whole = der_items(data)
    items = der_items(whole[0][1]) if whole and len(whole) == 1 else None
    if not items:
        return False
    tags = [tag for tag, _ in items]
    first = int.from_bytes(items[0][1][:8], "big") if tags[0] == INTEGER else None
    inner = [der_items(content) if tag == SEQUENCE else None for tag, content in items[:2]]
    if tags[0] == SEQUENCE:
        return tags == [SEQUENCE, OCTETS] and bool(inner[0]) and inner[0][0][0] == OID and inner[0][0][1].startswith(ENCRYPTION)
    if first in (0, 1) and tags[:9] == [INTEGER] * 9 and tags[9:] in ([], [SEQUENCE]):
        return True
    if first == 0 and tags == [INTEGER] * 6:
        return True
    rest = [tag & 0xE0 for tag in tags[2:]]
    if first == 1 and tags[:2] == [INTEGER, OCTETS] and len(items[1][1]) >= 16:
        return all(x == 0xA0 for x in rest)
    return first in (0, 1) and len(tags) >= 3 and tags[1:3] == [SEQUENCE, OCTETS] and bool(inner[1]) and inner[1][0][0] == OID and all(tag & 0xC0 == 0x80 for tag in tags[3:])


def ssh_fields(data: bytes, at: int, count: int) -> tuple[list[bytes], int] | None:
    """`count` length-prefixed fields from `at` on, and where they end."""
    out = []
    for _ in range(count):
        if at + 4 > len(data):
            return None
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        out.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return out, at


def private_ssh(data: bytes) -> bool:
    """True for an OpenSSH container to its end: cipher, key derivation, its options, keys, their public blobs, one private blob."""
    if not data.startswith(OPENSSH):
        return False
    head = ssh_fields(data, len(OPENSSH), 3)
    if not head or head[1] + 4 > len(data):
        return False
    count = int.from_bytes(data[head[1] : head[1] + 4], "big")
    body = ssh_fields(data, head[1] + 4, count + 1) if 1 <= count <= 64 else None
    return bool(body) and body[1] == len(data) and len(body[0][-1]) >= 8 and len(body[0][-1]) % 8 == 0 and all(ssh_fields(x, 0, 1) for x in body[0][:-1])


def signed_token(text: str) -> bool:
    """True if the first part is a JSON header that names an algorithm and the second is a JSON object."""
    head, body, _ = text.split(".", 2)
    try:
        header, claims = (json.loads(unbase64(x) or b"") for x in (head, body))
    except (ValueError, UnicodeDecodeError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(claims, dict)


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind; leftmost and non-overlapping within a kind."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    for m in PEM.finditer(text):
        data = unbase64(re.sub(r"\\[nr]|\s", "", m[3]))
        locked = "ENCRYPTED" in m[2] and data and len(data) % 8 == 0  # a body under a cipher has no structure of its own
        if data and (locked or private_der(data) or private_ssh(data)):
            found.append(("pem", *m.span()))
    for m in TOKEN.finditer(text):
        at = m[0].find("eyJ", 0, m[0].index("."))
        if at >= 0 and signed_token(m[0][at:]):
            found.append(("jwt", m.start() + at, m.end()))
    for m in BASE64.finditer(text):
        data = unbase64(m[0])
        if data and (private_der(data) or private_ssh(data)):
            found.append(("der" if data[0] == SEQUENCE else "ssh", *m.span()))
    for m in LONG_HEX.finditer(text):
        if len(m[0]) % 2 == 0:
            data = bytes.fromhex(m[0])
            if private_der(data) or private_ssh(data):
                found.append(("der" if data[0] == SEQUENCE else "ssh", *m.span()))
    return sorted(set(found), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scan_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `secrets`: array of (kind, start, end), code points, end exclusive.

    Base kinds (assign, access, hex) are what their patterns match. Kinds
    pem, der, ssh and jwt are reported only when the decoded bytes parse as a
    secret: a private key's DER shape with all lengths filled, an OpenSSH
    container to its end, a JSON header with an algorithm and JSON claims.
    Public keys, certificates and signatures are none. Null and empty texts
    have none; rows that repeat are scanned each; an empty table gives an
    empty one. A column named secrets is replaced; all others pass through.
    Whole texts, however long, are scanned in Arrow batches, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            rows = [[{"kind": k, "start": s, "end": e} for k, s, e in find_secrets(x)] if x else [] for x in b.column(0).to_pylist()]
            yield [pa.array(rows, type=kind)]

    return with_batches(docs, run, [("secrets", "array<struct<kind:string,start:long,end:long>>")], [text])
