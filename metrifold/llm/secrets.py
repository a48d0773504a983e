"""Secret scans confirmed by structure.

The base kinds are three patterns: a named assignment (``assign``), an access key id (``access``) and a long
lower-case hexadecimal run (``hex``), each leftmost and non-overlapping, with a least length. Beyond them,
base64 and hexadecimal candidates are decoded and reported only when their bytes parse: a signed token whose
header and payload are JSON objects and whose header names an algorithm (``jwt``; it may lack a signature only where
the algorithm is none), a private key in DER whose versions and nested lengths add up (``der``), an OpenSSH key whose
length-prefixed fields, as many as its key count asks for, add up (``openssh``), and PEM blocks around either, with
RFC 1421 headers too (``pem``). Base64 may be wrapped over lines, and a key may begin after a separator inside a run;
its own length says where it ends. Of an odd run of hexadecimal digits either end may be the one too many. Decoded
text is searched for the same again, ``depth`` encodings deep.

Defined cases: null text is empty and holds nothing; repeated rows are scanned as often as they come; offsets
are code points, the end exclusive; spans of the base kinds are never dropped for those of the method; extra columns
of whatever name are kept as they are.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrifold.llm.common import free_name, small_batches

KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "openssh")
DEPTH = 2
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # a match takes the whole run, so the length can stand in the pattern
_HEX = re.compile(r"[0-9a-f]{16,}")
_NAMES = ("pass", "secret", "token", "api")
_DOTTED = re.compile(r"[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*)+")
_ARMOUR = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]*PRIVATE KEY)-----")
_HEADER = re.compile(r"\s*[A-Za-z0-9-]+:[^\n]*(?:\n[ \t][^\n]*)*(?:\n|$)")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{32,}(?:\r?\n[ \t]*[A-Za-z0-9+/_-]+)*={0,2}")
_STARTS = re.compile(r"(?<![A-Za-z0-9])(?=M[A-P])|(?=b3BlbnNzaC1rZXktdjEA)")  # the first bytes of a DER sequence and of an OpenSSH key
_ANYHEX = re.compile(r"[0-9A-Fa-f]{64,}")
_CUT = re.compile(r"(?:^|(?<=[_-]))e[w-z]")
_BROKEN = re.compile("[\udc80-\udcff]")
_JSON = json.JSONDecoder()
_OPENSSH = b"openssh-key-v1\x00"
#: Object identifiers of RSA and EC keys in PKCS#8; fixed values.
_RSA, _EC = bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a8648ce3d0201")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


def _b64(s: str) -> bytes | None:
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the DER element at ``at``, None unless it fits."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size >= 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > end:
            return None
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
    return (tag, at, at + size) if at + size <= end else None


def _children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    out = []
    while at < end:
        e = _tlv(data, at, end)
        if e is None:
            return None
        out.append(e)
        at = e[2]
    return out


def _number(data: bytes, part: tuple[int, int, int]) -> int:
    return int.from_bytes(data[part[1] : part[2]], "big", signed=True) if part[2] - part[1] <= 4 else -1


def der_form(data: bytes) -> str | None:
    """Which private key it is, with all lengths adding up: rsa (version and eight integers), dsa (version 0 and five), ec (version 1, octets, its tagged fields) or pkcs8 around a key of its algorithm."""
    top = _tlv(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return None
    parts = _children(data, top[1], top[2])
    if not parts or parts[0][0] != 2:
        return None
    tags, version = [p[0] for p in parts], _number(data, parts[0])
    if tags == [2] * 9 or tags == [2] * 9 + [0x30]:
        return "rsa" if version == len(tags) - 9 else None
    if tags == [2] * 6:
        return "dsa" if version == 0 else None
    if tags[:2] == [2, 4] and version == 1:
        return "ec" if set(tags[2:]) <= {0xA0, 0xA1} and parts[1][2] > parts[1][1] else None
    if tags[:3] == [2, 0x30, 4] and version in (0, 1) and set(tags[3:]) <= {0xA0, 0x81, 0xA1}:
        algorithm, octets = _children(data, *parts[1][1:]), data[parts[2][1] : parts[2][2]]
        if not algorithm or algorithm[0][0] != 6:
            return None
        name, inner = data[algorithm[0][1] : algorithm[0][2]], _tlv(octets, 0, len(octets))
        if name in (_RSA, _EC):
            return "pkcs8" if der_form(octets) == ("rsa" if name == _RSA else "ec") else None
        return "pkcs8" if inner is not None and inner[2] == len(octets) and inner[0] in (2, 4, 0x30) else None
    return None


def is_der_key(data: bytes) -> bool:
    return der_form(data) is not None


def is_encrypted_key(data: bytes) -> bool:
    """PKCS#8 under encryption: an algorithm and octets."""
    top = _tlv(data, 0, len(data))
    parts = _children(data, top[1], top[2]) if top and top[0] == 0x30 and top[2] == len(data) else None
    if not parts or [p[0] for p in parts] != [0x30, 4]:
        return False
    algorithm = _children(data, *parts[0][1:])
    return bool(algorithm) and algorithm[0][0] == 6


def _openssh_end(read: Callable[[int, int], bytes], length: int) -> int | None:
    """Where an OpenSSH key ends: three strings, the count, so many public keys and the private part; None unless all fit. ``read(at, n)`` gives n of ``length`` bytes."""
    if read(0, len(_OPENSSH)) != _OPENSSH:
        return None

    def number(at: int) -> int | None:
        return int.from_bytes(read(at, 4), "big") if at + 4 <= length else None

    at = len(_OPENSSH)
    for _ in range(3):
        if (size := number(at)) is None:
            return None
        at += 4 + size
    keys = number(at)
    if keys is None or not 1 <= keys <= length // 4:
        return None
    at += 4
    for _ in range(keys + 1):
        if (size := number(at)) is None:
            return None
        at += 4 + size
    return at if at <= length else None


def is_openssh_key(data: bytes) -> bool:
    return _openssh_end(lambda at, n: data[at : at + n], len(data)) == len(data)


def _json_object(s: str) -> dict | None:
    raw = _b64(s) if s[:1] == "e" else None  # of an opening brace
    if not raw or raw[:1] != b"{":
        return None
    try:
        out = json.loads(raw)
    except (ValueError, RecursionError):
        return None
    return out if isinstance(out, dict) else None


def _names_algorithm(head: dict | None, signed: bool) -> bool:
    alg = head.get("alg") if head is not None else None
    return isinstance(alg, str) and (signed or alg.lower() == "none")


def is_jwt_header(header: str, signed: bool) -> bool:
    return _names_algorithm(_json_object(header), signed)


class _Tails:
    """JSON objects that end where a segment ends, from any of its places: a segment is decoded once for each place in a group of four."""

    def __init__(self, segment: str):
        self.segment, self.decoded = segment, {}

    def object_at(self, at: int) -> dict | None:
        first, size = at % 4, len(self.segment)
        if (size - at) % 4 == 1:
            return None
        if first not in self.decoded:
            raw = _b64(self.segment[first:]) or b""
            whole = raw.decode("utf-8", "surrogateescape")
            broken = _BROKEN.search(whole[::-1])  # the last byte that is not UTF-8
            after = len(whole[len(whole) - broken.start() :].encode()) if broken else len(raw)
            text = raw.decode("latin-1")  # a place for each byte; what JSON is made of is ASCII
            self.decoded[first] = text, len(raw) - after, len(text.rstrip(" \t\n\r"))
        text, valid, end = self.decoded[first]
        begin = (at - first) // 4 * 3
        if begin < valid or text[begin : begin + 1] != "{":
            return None
        try:
            out, stop = _JSON.raw_decode(text, begin)
        except (ValueError, RecursionError):
            return None
        return out if stop == end else None


def _tokens(text: str) -> list[tuple[str, int, int]]:
    """Signed tokens at any three neighbouring segments of a dotted run; a header may follow a separator inside its segment."""
    out = []
    for m in _DOTTED.finditer(text):
        parts = m[0].split(".")
        ends = [m.start() - 1]
        for part in parts:
            ends.append(ends[-1] + 1 + len(part))
        for i in range(len(parts) - 1):
            if _json_object(parts[i + 1]) is None:
                continue
            signed = i + 2 < len(parts) and parts[i + 2] != ""
            tails = _Tails(parts[i])
            for cut in _CUT.finditer(parts[i]):
                if _names_algorithm(tails.object_at(cut.start()), signed):
                    out.append(("jwt", ends[i] + 1 + cut.start(), ends[min(i + 3, len(parts))]))
                    break
    return out


def _blocks(text: str) -> list[tuple[str, int, int]]:
    """PEM blocks: each BEGIN with the next mark, where that is its END."""
    out, begin = [], None
    for m in _ARMOUR.finditer(text):
        if m[1] == "BEGIN":
            begin = m
        elif begin is not None and begin[2] == m[2]:
            body, at = text[begin.end() : m.start()].replace("\\r", "").replace("\\n", "\n"), 0
            while h := _HEADER.match(body, at):
                at = h.end()
            headers, data = body[:at], _b64("".join(body[at:].split())) or b""
            cipher = "ENCRYPTED" in headers and "DEK-Info:" in headers and len(data) >= 16 and len(data) % 8 == 0
            if cipher or is_der_key(data) or is_openssh_key(data) or "ENCRYPTED" in m[2] and is_encrypted_key(data):
                out.append(("pem", begin.start(), m.end()))
            begin = None
    return out


def _kind(data: bytes, depth: int) -> str | None:
    """What decoded bytes hold."""
    if data[:1] == b"\x30" and is_der_key(data):
        return "der"
    if is_openssh_key(data):
        return "openssh"
    if depth and data.isascii() and (inner := confirmed_spans(data.decode("ascii"), depth - 1)):
        return inner[0][0]
    return None


def _read(text: str, start: int, at: int, n: int) -> bytes:
    """``n`` of the bytes, from ``at`` on, that base64 from ``start`` on stands for."""
    skip = at % 3
    return (_b64(text[(a := start + at // 3 * 4) : a + -(-(skip + n) * 4 // 3)]) or b"")[skip : skip + n]


def _may_be_key(text: str, start: int, head: int, size: int) -> bool:
    """Whether the lengths of a DER sequence's parts, a small version first, add up to ``size``; only their heads are decoded."""
    at, parts = head, 0
    while at < size:
        e = _read(text, start, at, 6)
        if len(e) < 2 or parts == 10 or not parts and (e[0] != 2 or not 1 <= e[1] <= 4):  # no key has more parts
            return False
        extra = e[1] & 0x7F if e[1] >= 0x80 else 0
        if extra > 4 or e[1] == 0x80:
            return False
        at, parts = at + 2 + extra + (int.from_bytes(e[2 : 2 + extra], "big") if extra else e[1]), parts + 1
    return at == size


def _encoded(text: str, depth: int) -> list[tuple[str, int, int]]:
    """Base64 runs, whole or from a key's beginning to where its own length ends, over line breaks too."""
    out = []
    for m in _RUN.finditer(text):
        first = m[0].split("\n", 1)[0].rstrip("\r")
        if (data := _b64(first)) and (kind := _kind(data, depth)):
            out.append((kind, m.start(), m.start() + len(first)))
            continue
        places = [i for i, c in enumerate(m[0]) if c not in "\r\n\t "] if "\n" in m[0] else range(len(m[0]))
        joined = "".join(map(m[0].__getitem__, places)) if "\n" in m[0] else m[0]
        done, breaks = 0, {k for k in range(1, len(places)) if places[k] > places[k - 1] + 1}
        starts = {x.start() for x in _STARTS.finditer(joined)} | {k for k in breaks if _STARTS.match(joined[k : k + 20])}
        bare = len(joined.rstrip("="))
        for at in sorted(starts):
            head = _b64(joined[at : at + 8]) or b""
            if at < done or len(head) < 6:
                continue
            if head[0] == 0x30:
                extra = head[1] & 0x7F if head[1] >= 0x80 else 0
                size = 2 + extra + int.from_bytes(head[2 : 2 + extra], "big") if extra else 2 + head[1]
                chars = -(-size * 4 // 3)
                if extra > 4 or size < 24 or chars > bare - at or not _may_be_key(joined, at, 2 + extra, size) or not is_der_key(_b64(joined[at : at + chars]) or b""):
                    continue
                kind = "der"
            else:
                size = _openssh_end(partial(_read, joined, at), (bare - at) * 3 // 4)
                if size is None:
                    continue
                chars, kind = -(-size * 4 // 3), "openssh"
            end = at + chars
            while end < len(joined) and joined[end] == "=" and (end - at) % 4:
                end += 1
            out.append((kind, m.start() + places[at], m.start() + places[end - 1] + 1))
            done = end
        if not done and "\n" in m[0]:  # the other lines by themselves, and all lines as one text
            at = m.start()
            for line in m[0].split("\n"):
                word = line.strip()
                if at > m.start() and len(word) >= 32 and (data := _b64(word)) and (kind := _kind(data, depth)):
                    begin = at + line.index(word)
                    out.append((kind, begin, begin + len(word)))
                at += len(line) + 1
            if (data := _b64(joined)) and (kind := _kind(data, depth)):
                out.append((kind, m.start(), m.end()))
    return out


def _hexed(text: str, depth: int) -> list[tuple[str, int, int]]:
    out = []
    for m in _ANYHEX.finditer(text):
        n = len(m[0])
        for at in (0, 1) if n % 2 else (0,):
            if kind := _kind(bytes.fromhex(m[0][at : at + n // 2 * 2]), depth):
                out.append((kind, m.start() + at, m.start() + at + n // 2 * 2))
                break
    return out


def confirmed_spans(text: str, depth: int = DEPTH) -> list[tuple[str, int, int]]:
    """Candidates whose decoded bytes parse as keys or signed tokens."""
    out = _tokens(text) if ".e" in text else []
    if "PRIVATE KEY-----" in text:
        out += _blocks(text)
    return out + _encoded(text, depth) + _hexed(text, depth)


def _ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(set(spans), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in _ordered(spans))


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """``text`` with each maximal overlap of spans replaced by ``mark``."""
    out, at = [], 0
    for _, a, b in _ordered(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of each row."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict = {name: [] for name in schema.names} | {"doc_id": batch.column("doc_id")}
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                for kind in KINDS[:3]:
                    out[f"n_{kind}"].append(sum(s[0] == kind for s in base))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(base + confirmed_spans(text or "", depth)))
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", depth: int = DEPTH) -> DataFrame:
    """``docs`` with every found span of ``text_col`` replaced by ``mark``; n_chars, where there is one, is set anew for changed rows."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(series):
        return series.map(lambda t: t if t is None else redacted(t, base_spans(t) + confirmed_spans(t, depth), mark))

    clear = free_name(docs.columns, "clean")
    out = docs.withColumn(clear, clean(F.col(text_col)))
    columns = []
    for name in docs.columns:
        if name == text_col:
            columns.append(F.col(clear).alias(name))
        elif name == "n_chars":
            columns.append(F.when(F.col(clear).eqNullSafe(F.col(text_col)), F.col(name)).otherwise(F.char_length(clear).cast("long")).alias(name))
        else:
            columns.append(F.col(name))
    return out.select(columns)
