"""Secret scans with structural confirmation.

Base patterns find assignments, access key ids and long hex runs. Beside them, base64 and hex candidates are
decoded and reported only when their bytes parse: DER key encodings and PKCS#12 stores whose nested lengths fill their
parents exactly, OpenSSH private keys, whole PEM files in base64 (as secret manifests hold them) around one of these, and
signed tokens: a header that is a JSON object and names an algorithm other than "none", a payload and a signature that
decode. Public keys are findings of their own kind and are not redacted. Lines of one key may be parted by line feeds,
by their escapes in JSON (backslash-n), and be indented.

A run of base64 lines is joined once and decoded at most once for each of the four places in a quantum where a key may
begin; keys are then parsed by offset, by as many headers as they have parts. So a text of any shape costs time in step
with its length.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakequill.llm.common import ship, text_or_empty, trim_worker

# The base patterns of the contract; letters of the key words in either case.
ASSIGN = re.compile(
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
_BREAK = r"(?:\\[rn]|[\r\n])+[ \t]*"
BASE64 = re.compile(rf"[A-Za-z0-9+/_-]{{24,}}(?:{_BREAK}[A-Za-z0-9+/_-]+)*={{0,2}}")
KEY_START = re.compile(r"(?:(?<=[\r\n \t])|(?<=\\[rn]))(?:M|b3BlbnNzaC1rZXkt)")
_PART = re.compile(r"(?:\\[rn]|[\r\n \t])+")
ANY_HEX = re.compile(r"[0-9a-fA-F]{48,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])e[wy][A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")  # of a brace and what may follow it
KINDS = ("assign", "access", "hex", "jwt", "der_key", "ssh_key", "public_key")
OIDS = {  # fixed values: object identifiers of key algorithms, as their DER content bytes in hex
    "2a864886f70d010101": "rsa",
    "2a8648ce3d0201": "ec",
    "2a8648ce380401": "dsa",
    "2b6570": "ed25519",
    "2b656e": "x25519",
    "2b6571": "ed448",
    "2b656f": "x448",
    "2a864886f70d01010a": "rsa-pss",
}
PBE = "2a864886f70d0105"  # fixed value: password-based encryption, before its number in PKCS#5
PKCS12 = ("2a864886f70d010701", "2a864886f70d010702")  # fixed values: data and signed data, which a PKCS#12 store wraps
SSH_MAGIC, SSH_BASE64, PEM_BASE64 = b"openssh-key-v1\0", "b3BlbnNzaC1rZXkt", "LS0tLS1CRUdJTi"
PEM = re.compile(rb"-----BEGIN [A-Z0-9 ]+-----\s([A-Za-z0-9+/=\s]*)-----END [A-Z0-9 ]+-----")
#: Items that one level of a key may have; no encoding has as many.
MOST_ITEMS = 16


def _der_header(b: bytes, i: int, end: int) -> tuple[int, int, int] | None:
    """(tag, begin and end of the content) of the DER item at i, or None if it isn't one that ends by end."""
    if i + 2 > end:
        return None
    tag, n = b[i], b[i + 1]
    i += 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or i + k > end or b[i] == 0:
            return None
        n, i = int.from_bytes(b[i : i + k], "big"), i + k
        if n < 0x80:
            return None
    return (tag, i, i + n) if i + n <= end else None


def der_items(b: bytes, i: int = 0, end: int | None = None) -> list[tuple[int, int, int]] | None:
    """(tag, begin, end) of the contents of the DER items that fill b from i to end exactly; None unless they do, and are MOST_ITEMS at most."""
    end, out = len(b) if end is None else end, []
    while i < end:
        item = _der_header(b, i, end)
        if item is None or len(out) == MOST_ITEMS:
            return None
        out.append(item)
        i = item[2]
    return out


def der_key_at(b: bytes, at: int) -> tuple[str, int] | None:
    """(kind, end) of the DER key at a place of b: der_key for a PKCS#1, SEC 1, DSA, PKCS#8 or encrypted PKCS#8 private key or a PKCS#12 store, public_key for PKCS#1 or SubjectPublicKeyInfo, by nested lengths and types."""
    top = _der_header(b, at, len(b))
    if top is None or top[0] != 0x30 or top[2] - at < 32:
        return None
    items = der_items(b, top[1], top[2])
    kind = _kind_of(b, items) if items else None
    return (kind, top[2]) if kind else None


def _kind_of(b: bytes, items: list[tuple[int, int, int]]) -> str | None:
    tags, size = [t for t, _, _ in items], [e - i for _, i, e in items]
    first = b[items[0][1] : items[0][1] + 2] if tags[0] == 0x02 and size[0] == 1 else None
    if first is not None and first[0] in (0, 1):
        if len(tags) >= 9 and set(tags[:9]) == {0x02} and size[1] >= 32:
            return "der_key"
        if tags == [0x02] * 6 and first[0] == 0 and size[1] >= 64:
            return "der_key"
        if len(tags) >= 2 and tags[1] == 0x04 and first[0] == 1 and 16 <= size[1] <= 66:
            return "der_key"
        if len(tags) >= 3 and tags[1] == 0x30 and tags[2] == 0x04:
            return "der_key" if _names(b, items[1], OIDS) else None
    if first is not None and first[0] == 3 and tags[1:2] == [0x30] and len(tags) <= 3:
        return "der_key" if _names(b, items[1], PKCS12) else None
    if tags == [0x30, 0x03]:
        return "public_key" if _names(b, items[0], OIDS) else None
    if tags == [0x30, 0x04]:
        inner = der_items(b, *items[0][1:])
        return "der_key" if inner and inner[0][0] == 0x06 and b[inner[0][1] : inner[0][2]].hex().startswith(PBE) else None
    return "public_key" if tags == [0x02, 0x02] and size[0] >= 64 and size[1] <= 8 else None


def _names(b: bytes, item: tuple[int, int, int], oids) -> bool:
    """Whether an item's content begins with one of the object identifiers."""
    items = der_items(b, item[1], item[2])
    return bool(items) and items[0][0] == 0x06 and b[items[0][1] : min(items[0][2], items[0][1] + 16)].hex() in oids


def ssh_key_end(b: bytes, at: int) -> int | None:
    """The end of the OpenSSH private key at a place of b: its magic, then cipher, kdf and options, the count of keys, a public key for each and the private part as length-prefixed strings."""
    if not b.startswith(SSH_MAGIC, at):
        return None
    i, left = at + len(SSH_MAGIC), 3
    counted = False
    while True:
        if i + 4 > len(b):
            return None
        n = int.from_bytes(b[i : i + 4], "big")
        i += 4
        if left == 0 and not counted:
            if not 1 <= n <= 16:
                return None
            left, counted = n + 1, True
            continue
        i, left = i + n, left - 1
        if i > len(b):
            return None
        if left == 0 and counted:
            return i


def key_at(b: bytes, at: int) -> tuple[str, int] | None:
    """(kind, end) of the key that begins at a place of b."""
    end = ssh_key_end(b, at)
    return ("ssh_key", end) if end is not None else der_key_at(b, at)


def is_token_header(part: str) -> bool:
    """Whether part decodes to a JSON object that names the algorithm of a signed token."""
    try:
        head = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and head["alg"].strip().lower() not in ("", "none")


def is_signed_token(token: str) -> bool:
    """Whether header, payload and signature of a dotted token decode, and the header names how it is signed."""
    head, payload, signature = token.split(".")
    return is_token_header(head) and _decoded(payload) is not None and _decoded(signature) is not None


def _decoded(s: str) -> bytes | None:
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


class _Run:
    """The lines of a run of base64, joined once; bytes from any place of them, decoded once for each place in a quantum."""

    def __init__(self, text: str, start: int, end: int):
        self.end, self.starts, self.stops, lines, size, at = end, {}, {}, [], 0, start
        while at < end:
            brk = _PART.search(text, at, end)
            stop = brk.start() if brk else end
            line = text[at:stop].rstrip("=")
            self.starts[at] = size
            size += len(line)
            self.stops[size] = stop
            lines.append((at, size - len(line), line))
            at = brk.end() if brk else end
        self.lines = lines
        self.joined = "".join(x for *_, x in lines).replace("-", "+").replace("_", "/")
        self._bytes: dict[int, bytes] = {}

    def decoded(self, offset: int) -> tuple[bytes, int]:
        """(bytes, place): what the characters from an offset of the joined lines stand for begins at that place of the bytes."""
        way = offset % 4
        if way not in self._bytes:
            s = self.joined[way:]
            s = s[: len(s) - (len(s) % 4 == 1)]
            self._bytes[way] = base64.b64decode(s + "=" * (-len(s) % 4))
        return self._bytes[way], (offset - way) // 4 * 3

    def text_place(self, offset: int) -> int:
        """Where in the text the character at an offset of the joined lines lies."""
        i = bisect.bisect_right(self.lines, offset, key=lambda x: x[1]) - 1
        return self.lines[i][0] + offset - self.lines[i][1]

    def keys(self, places):
        """(start, end, kind) of the keys that begin at places of the text, and end where a line or the run does; none begins inside another."""
        past = 0
        for at in places:
            offset = self.starts.get(at)
            if offset is None or at < past or self.joined[offset : offset + 1] not in ("M", "b"):
                continue
            b, i = self.decoded(offset)
            key = key_at(b, i)
            if key and (stop := self.stops.get(offset - (-(key[1] - i) * 4 // 3))) is not None:
                past = stop
                yield at, stop, key[0]

    def files(self):
        """(start, end, kind) of the PEM files that hold a key and lie in the run as base64."""
        for way in {m.start() % 4 for m in re.finditer(PEM_BASE64, self.joined)}:
            b, _ = self.decoded(way)
            for m in PEM.finditer(b):
                body = _decoded(b"".join(m[1].split()).decode())
                key = key_at(body, 0) if body else None
                if key and key[1] == len(body):
                    a, e = way + m.start() * 4 // 3, way - (-m.end() * 4 // 3)
                    stop = self.end if e >= len(self.joined) else self.text_place(e - 1) + 1
                    yield self.text_place(a), stop, key[0]


def _hex_key(run: str) -> str | None:
    """The kind of the key that a whole run of hex digits is."""
    if len(run) % 2 or not run.lower().startswith(("30", SSH_MAGIC.hex())):
        return None
    b = bytes.fromhex(run)
    key = key_at(b, 0)
    return key[0] if key and key[1] == len(b) else None


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every finding in code points, end exclusive, by start, then kind as listed in KINDS."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if "ey" in text or "ew" in text:
        found += [(m.start(), m.end(), "jwt") for m in TOKEN.finditer(text) if is_signed_token(m[0])]
    if "M" in text or SSH_BASE64 in text or PEM_BASE64[:3] in text:  # base64 of a DER sequence's tag, and of the OpenSSH magic
        for m in BASE64.finditer(text):
            # the letter of an escaped line feed before a run isn't part of it
            start = m.start() + (text[m.start()] in "rn" and text[m.start() - 1 : m.start()] == "\\")
            places = [start, *(x.start() for x in KEY_START.finditer(text, start + 1, m.end()))]
            places = [x for x in places if text[x] in "Mb"]
            coded = PEM_BASE64[:3] in m[0]  # its other letters may stand on the next line
            if places or coded:
                run = _Run(text, start, m.end())
                found += run.keys(places)
                found += run.files() if coded else ()
    if "30" in text or "6f" in text or "6F" in text:
        found += [(m.start(), m.end(), kind) for m in ANY_HEX.finditer(text) if (kind := _hex_key(m[0]))]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def _run(batches):
    import pyarrow as pa

    trim_worker()
    base = KINDS[:3]
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_spans")}
        for text in batch.column("_lq_text").to_pylist():
            spans = scan(text)
            for k in base:
                out[f"n_{k}"].append(sum(x[2] == k for x in spans))
            out["base_sha256"].append(hashlib.sha256(joined(x for x in spans if x[2] in base).encode()).hexdigest())
            out["spans"].append(joined(spans))
            out["n_spans"].append(len(spans))
        types = {"base_sha256": pa.string(), "spans": pa.string()}
        yield pa.RecordBatch.from_arrays([batch.column("_lq_id"), *(pa.array(v, types.get(k, pa.int64())) for k, v in out.items())], names=["_lq_id", *out])


def secret_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_spans.

    Texts are scanned whole; null and empty texts have no findings. Repeated rows are scanned each; null ids stay.
    Further columns are ignored. One pass without a shuffle.
    """
    ship(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    read = docs.select(F.col(doc_id).alias("_lq_id"), text_or_empty(text).alias("_lq_text"))
    out = read.mapInArrow(_run, f"_lq_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long")
    return out.withColumnRenamed("_lq_id", "doc_id")


def _redact(at: int):
    def run(batches):
        import pyarrow as pa

        trim_worker()
        for batch in batches:
            out = []
            for text in batch.column(at).to_pylist():
                if text is None:
                    out.append(None)
                    continue
                parts, past = [], 0
                for s, e, k in (x for x in scan(text) if x[2] != "public_key"):
                    if s >= past:
                        parts += [text[past:s], f"[{k}]"]
                    past = max(past, e)
                out.append("".join(parts) + text[past:])
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return run


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every finding in text but public keys replaced by its kind in brackets; all rows and columns stay, null texts too.

    Overlapping findings are replaced once, under the name of the first.
    """
    ship(docs.sparkSession)
    read = docs.withColumn(text, F.col(text).cast("string"))
    return read.mapInArrow(_redact(docs.columns.index(text)), read.schema)
