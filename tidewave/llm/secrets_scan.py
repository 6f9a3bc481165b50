"""Secret scans: keyword automaton, anchored expressions near hits, checksum validation.

One Aho-Corasick pass over the lower-cased text finds keywords; each keyword's
expression is tried only where a hit starts, from left to right, after the end
of the kind's last match. Long hexadecimal runs have no keyword; there one
plain expression scans the text. Kinds:

assign, access, hex   the base kinds; see RULES.
forge                 gh[pousr]_ or npm_ tokens of 36 letters and digits whose last
                      six are the base-62 CRC-32 of the thirty before them.
jwt                   three base64url parts of which the first decodes to a JSON header.
pem                   private key blocks whose body is base64 of whole DER length.

forge, jwt and pem are kept only if the embedded checksum or structure holds.
"""

from __future__ import annotations

import base64
import binascii
import functools
import hashlib
import json
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "forge", "jwt", "pem")
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_HEX = re.compile("[0-9a-f]{24,}")
#: keyword -> (kind, expression matched from the keyword's start, whether on lower-cased text)
_ASSIGN = re.compile("""(password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?([a-z0-9+/_.=-]+)""")
RULES = {
    **{w: ("assign", _ASSIGN) for w in ("password", "passwd", "secret", "token", "apikey", "api_key")},
    "akia": ("access", re.compile("AKIA[A-Z0-9]+")),
    **{f"gh{c}_": ("forge", re.compile("gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])")) for c in "pousr"},
    "npm_": ("forge", re.compile("npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])")),
    "eyj": ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")),
    "-----begin": ("pem", re.compile(r"-----BEGIN ((?:[A-Z]+ )?PRIVATE KEY)-----([A-Za-z0-9+/=\s]+)-----END \1-----")),
}


@functools.cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, (kind, pattern) in RULES.items():
        a.add_word(word, (len(word), kind, pattern))
    a.make_automaton()
    return a


def base62(n: int, width: int) -> str:
    out = ""
    while n:
        n, d = divmod(n, 62)
        out = _DIGITS[d] + out
    return out.rjust(width, "0")


def _decoded(part: str) -> bytes:
    return base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))


def _valid(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[2]) >= 6
    if kind == "access":
        return len(m[0]) >= 20
    if kind == "forge":
        return base62(zlib.crc32(m[1][:30].encode()), 6) == m[1][30:]
    try:
        if kind == "jwt":
            head = json.loads(_decoded(m[0].partition(".")[0]))
            return isinstance(head, dict) and "alg" in head
        der = base64.b64decode("".join(m[2].split()), validate=True)
        if der[:1] != b"\x30" or len(der) < 2:
            return False
        if der[1] < 128:
            return len(der) == 2 + der[1]
        size = der[1] & 127
        return len(der) == 2 + size + int.from_bytes(der[2 : 2 + size], "big")
    except (ValueError, binascii.Error, UnicodeDecodeError):
        return False


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind as listed."""
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    hits = sorted((end + 1 - n, kind, p) for end, (n, kind, p) in _automaton().iter(low)) if any(map(low.__contains__, RULES)) else []
    found, after = [], dict.fromkeys(KINDS, 0)
    for start, kind, pattern in hits:
        if start >= after[kind] and (m := pattern.match(low if kind == "assign" else text, start)):
            after[kind] = m.end()
            if _valid(kind, m):
                found.append((kind, start, m.end()))
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def _run(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            b = batch.slice(at, 256)
            found = [scan(t or "") for t in b.column(1).to_pylist()]
            base = [[s for s in f if s[0] in BASE] for f in found]
            counts = [pa.array([sum(s[0] == kind for s in f) for f in base], pa.int64()) for kind in BASE]
            spans = pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in f] for f in found], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
            digest = pa.array([hashlib.sha256(joined(f).encode()).hexdigest() for f in base], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, digest, spans], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "found"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, found array<struct<kind,start,end>>; a row for each input row.

    Null texts count as empty; other columns are not read; repeated rows stay; texts of
    any length are scanned whole, and an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<kind:string,start:bigint,end:bigint>>")


def with_span_text(found: DataFrame) -> DataFrame:
    """found as one string of kind:start:end, comma-joined."""
    parts = F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return found.withColumn("spans", F.concat_ws(",", parts)).drop("found")
