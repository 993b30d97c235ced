"""Secrets in text: patterns propose, structure confirms.

Base spans come from three fixed patterns. The method adds spans whose
contents prove what they are: runs of base64 or hexadecimal digits are decoded
and parsed as key encodings, where every nested length has to fit exactly.

- ``jwt``: a signed token, whose header is a JSON object that names its
  algorithm and whose signature is as long as that algorithm makes it (for an
  encrypted token: five parts, and a header that names the encryption).
- ``rsa_key``, ``dsa_key``, ``ec_key``, ``pkcs8_key``, ``encrypted_key``: DER
  private keys; ``openssh_key``: the OpenSSH container with its length-prefixed
  fields. A decoded text that is itself a PEM block counts as what it holds.
- ``pem``: a private key block whose body is one of those.

Offsets are code points, end exclusive. All patterns are ASCII, so texts are
searched as UTF-8 bytes; runs of a byte class are found by whole-array passes.

Defined results: null and empty texts have no spans; spans of different kinds
may overlap, those at one start are listed in the order of ``KINDS``; a run
that lies in a ``pem`` span is not reported again; repeated rows keep their
multiplicity; a null id stays null; other input columns are ignored; an empty
table gives an empty table.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import textops as T

BASE = ("assign", "access", "hex")
ADDED = ("pem", "jwt", "rsa_key", "dsa_key", "ec_key", "pkcs8_key", "encrypted_key", "openssh_key")
KINDS = BASE + ADDED

# Base patterns and their least lengths. Byte patterns ignore the
# case of ASCII letters only.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16

PEM = re.compile(rb"-----BEGIN ([A-Z0-9 ]{0,40})PRIVATE KEY-----([^-]*)-----END \1PRIVATE KEY-----")
_JWT = re.compile(rb"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*)+")
_TOKEN = re.compile(rb"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}")
#: Base64 of what the parsers accept: a DER sequence, the OpenSSH magic, a PEM block.
_STARTS = (b"M", b"b3BlbnNzaC1rZXktdjE", b"LS0tLS1CRUdJTi")
#: Decoding goes at most this deep (base64 of PEM of base64).
DEPTH = 3

# Signature bytes of a signed token's algorithm.
SIGNATURE = {"none": (0, 0), "HS256": (32, 32), "HS384": (48, 48), "HS512": (64, 64), "ES256": (64, 64),
             "ES256K": (64, 64), "ES384": (96, 96), "ES512": (132, 132), "EdDSA": (57, 114),
             "RS256": (128, 1024), "RS384": (128, 1024), "RS512": (128, 1024),
             "PS256": (128, 1024), "PS384": (128, 1024), "PS512": (128, 1024)}


def _class(chars: bytes) -> np.ndarray:
    mask = np.zeros(256, dtype=bool)
    mask[list(chars)] = True
    return mask


_DIGITS, _UPPER, _LOWER = bytes(range(48, 58)), bytes(range(65, 91)), bytes(range(97, 123))
HEX, CAPITAL = _class(_DIGITS + b"abcdef"), _class(_DIGITS + _UPPER)
CODED = _class(_DIGITS + _UPPER + _LOWER + b"+/_=.-")


def runs(part: T.Slice, mask: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Byte ranges of the runs of a class within rows, of ``least`` bytes."""
    inside = mask[part.data]
    if not inside.any():
        return []
    first = np.zeros(len(inside) + 1, dtype=bool)
    first[part.offsets] = True
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    stops[:-1] &= ~inside[1:] | first[1:-1]
    lo, hi = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    long = hi - lo >= least
    return list(zip(lo[long].tolist(), hi[long].tolist()))


# -- encodings ------------------------------------------------------------
def elements(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, contents) of the DER elements that make up ``data``, or None if
    a length does not fit."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data) or data[at] & 0x1F == 0x1F:
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            size = n & 0x7F
            if not 1 <= size <= 4 or at + size > len(data):
                return None
            n = int.from_bytes(data[at:at + size], "big")
            if n < 0x80 or n >> 8 * (size - 1) == 0:  # not the shortest form
                return None
            at += size
        if at + n > len(data):
            return None
        out.append((tag, data[at:at + n]))
        at += n
    return out


INT, BITS, OCTETS, OID, SEQ = 0x02, 0x03, 0x04, 0x06, 0x30


def der_key(data: bytes) -> str | None:
    """Kind of a DER private key, None for everything else."""
    outer = elements(data)
    if not outer or len(outer) != 1 or outer[0][0] != SEQ:
        return None
    parts = elements(outer[0][1])
    if not parts:
        return None
    tags = [t for t, _ in parts]
    if any(t == INT and not x for t, x in parts):
        return None

    def algorithm(x: bytes) -> bool:
        inner = elements(x)
        return bool(inner) and inner[0][0] == OID and len(inner[0][1]) > 1 and len(inner) <= 2

    if tags[:9] == [INT] * 9 and len(tags) <= 10 and parts[0][1] in (b"\0", b"\1") and len(parts[1][1]) >= 32:
        return "rsa_key"
    if tags == [INT] * 6 and parts[0][1] == b"\0" and len(parts[1][1]) >= 32:
        return "dsa_key"
    if tags[:2] == [INT, OCTETS] and parts[0][1] == b"\1" and len(parts[1][1]) >= 16 and all(
            t in (0xA0, 0xA1) for t in tags[2:]):
        inner = [elements(x) for _, x in parts[2:]]
        return "ec_key" if all(x and len(x) == 1 and x[0][0] in (OID, BITS, SEQ) for x in inner) else None
    if tags[:3] == [INT, SEQ, OCTETS] and parts[0][1] in (b"\0", b"\1") and all(t in (0xA0, 0xA1, 0x81) for t in tags[3:]):
        return "pkcs8_key" if algorithm(parts[1][1]) and elements(parts[2][1]) else None
    if tags == [SEQ, OCTETS] and len(parts[1][1]) >= 16 and algorithm(parts[0][1]):
        return "encrypted_key"
    return None


def openssh_key(data: bytes) -> str | None:
    """OpenSSH container: magic, three strings, the number of keys, a public
    part each and the private part; without cipher its check values agree."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return None
    at = len(magic)

    def number() -> int:
        nonlocal at
        if at + 4 > len(data):
            raise ValueError
        at += 4
        return int.from_bytes(data[at - 4:at], "big")

    def string() -> bytes:
        nonlocal at
        n = number()
        if at + n > len(data):
            raise ValueError
        at += n
        return data[at - n:at]

    try:
        cipher = string()
        string(), string()
        keys = number()
        if not 1 <= keys <= 64:
            return None
        for _ in range(keys):
            string()
        private = string()
    except ValueError:
        return None
    if at != len(data) or len(private) < 8 or (cipher == b"none" and private[:4] != private[4:8]):
        return None
    return "openssh_key"


def _base64(token: bytes) -> bytes | None:
    body = token.rstrip(b"=")
    if len(body) % 4 == 1 or (b"+" in body or b"/" in body) and (b"-" in body or b"_" in body):
        return None
    try:
        return base64.b64decode(body.replace(b"-", b"+").replace(b"_", b"/") + b"=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return None


def key_of(data: bytes, depth: int = DEPTH) -> str | None:
    """Kind of the private key that ``data`` encodes."""
    if data[:1] == b"\x30":
        return der_key(data)
    if data.startswith(b"openssh"):
        return openssh_key(data)
    if depth and data.startswith(b"-----BEGIN"):
        m = PEM.match(data)
        return block_of(m, depth - 1) if m else None
    return None


def block_of(m: re.Match, depth: int = DEPTH) -> str | None:
    """Kind of the key in a PEM block; header lines (name: value) are left out."""
    lines = [x.strip() for x in re.split(rb"\\n|\n", m[2]) if b":" not in x]
    data = _base64(b"".join(b"".join(lines).split()))
    if data is None or not data:
        return None
    if b"ENCRYPTED" in m[1] or b"ENCRYPTED" in m[2]:  # old style: encrypted blocks have whole cipher blocks
        return key_of(data, depth) or ("encrypted_key" if len(data) % 8 == 0 else None)
    return key_of(data, depth)


def token_key(token: bytes) -> str | None:
    """Kind of the private key that a run of base64 or hexadecimal digits is."""
    if len(token) % 2 == 0 and token[:2] in (b"30", b"6f", b"6F"):
        try:
            if kind := key_of(bytes.fromhex(token.decode())):
                return kind
        except ValueError:
            pass
    if token.startswith(_STARTS):
        data = _base64(token)
        return key_of(data) if data else None
    return None


def signed_token(token: bytes) -> bool:
    """Whether a dotted run is a signed or encrypted token."""
    parts = token.split(b".")
    if len(parts) not in (3, 5):
        return False

    def fields(x: bytes) -> dict | None:
        raw = _base64(x)
        try:
            out = json.loads(raw) if raw else None
        except (ValueError, RecursionError):
            return None
        return out if isinstance(out, dict) else None

    head = fields(parts[0])
    if head is None or not isinstance(head.get("alg"), str):
        return False
    if len(parts) == 5:
        return isinstance(head.get("enc"), str) and all(_base64(x) is not None for x in parts[1:])
    sign = _base64(parts[2])
    if sign is None or fields(parts[1]) is None:
        return False
    least, most = SIGNATURE.get(head["alg"], (1, 1 << 16))
    return least <= len(sign) <= most


# -- spans ----------------------------------------------------------------
def spans(part: T.Slice) -> dict[int, list[tuple[int, int, int]]]:
    """Per row with any: (first byte in the row, number of the kind, last)."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    offsets = part.offsets

    def add(kind: str, lo: int, hi: int, row: int | None = None) -> None:
        if row is None:
            row = int(np.searchsorted(offsets, lo, side="right")) - 1
            lo, hi = lo - int(offsets[row]), hi - int(offsets[row])
        found.setdefault(row, []).append((lo, KINDS.index(kind), hi))

    for lo, hi in runs(part, HEX, HEX_LEAST):
        add("hex", lo, hi)
    for lo, hi in runs(part, CAPITAL, ACCESS_LEAST):
        m = ACCESS.search(part.data[lo:hi].tobytes())
        if m and m.end() - m.start() >= ACCESS_LEAST:
            add("access", lo + m.start(), lo + m.end())
    blocks: dict[int, list[tuple[int, int]]] = {}
    for row in range(len(part)):
        text = part.text(row)
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= ASSIGN_LEAST:
                add("assign", m.start(), m.end(), row)
        if b"-----BEGIN" in text:
            for m in PEM.finditer(text):
                if block_of(m):
                    add("pem", m.start(), m.end(), row)
                    blocks.setdefault(row, []).append(m.span())
    for lo, hi in runs(part, CODED, 32):
        row = int(np.searchsorted(offsets, lo, side="right")) - 1
        at = lo - int(offsets[row])
        if any(a <= at < b for a, b in blocks.get(row, ())):
            continue
        text = part.data[lo:hi].tobytes()
        if b"eyJ" in text:
            for m in _JWT.finditer(text):
                token = m[0].rstrip(b".") if m[0].count(b".") > 2 else m[0]  # a full stop after it
                if signed_token(token):
                    add("jwt", at + m.start(), at + m.start() + len(token), row)
        for m in _TOKEN.finditer(text):
            if kind := token_key(m[0]):
                add(kind, at + m.start(), at + m.end(), row)
    return found


def _scan(batches):
    for batch in batches:
        for part in T.slices(batch.column(1)):
            found = spans(part)
            n = len(part)
            counts = np.zeros((n, len(BASE)), dtype=np.int64)
            more = np.zeros(n, dtype=np.int64)
            digest, joined = [hashlib.sha256(b"").hexdigest()] * n, [""] * n
            for row, own in found.items():
                data = part.data[part.offsets[row]:part.offsets[row + 1]]
                points = np.append(0, np.cumsum((data & 0xC0) != 0x80))  # code points before a byte
                own.sort()
                text = [(k, f"{KINDS[k]}:{points[lo]}:{points[hi]}") for lo, k, hi in own]
                for k, _ in text:
                    if k < len(BASE):
                        counts[row, k] += 1
                    else:
                        more[row] += 1
                digest[row] = hashlib.sha256(",".join(x for k, x in text if k < len(BASE)).encode()).hexdigest()
                joined[row] = ",".join(x for _, x in text)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(part.first, n), *[pa.array(counts[:, k]) for k in range(len(BASE))],
                pa.array(more), pa.array(digest, pa.string()), pa.array(joined, pa.string())],
                names=["id", *[f"n_{k}" for k in BASE], "n_confirmed", "base_sha256", "spans"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``id_col``, n_assign, n_access, n_hex, n_confirmed (spans
    the method adds), base_sha256 (of the base spans) and spans (all)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return own.mapInArrow(_scan, f"id {id_type}, n_assign long, n_access long, n_hex long, n_confirmed long, "
                                 "base_sha256 string, spans string").withColumnRenamed("id", id_col)
