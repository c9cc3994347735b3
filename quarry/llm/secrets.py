"""Finds secrets: keywords by one automaton, patterns only where a keyword stands, checksums that a token carries.

An Aho-Corasick automaton of all keywords reads a text once. At each of its hits a regular expression
is tried that begins right there; hits inside a match that has been taken are passed over, so that
matches of a kind are the leftmost ones that don't overlap. Runs of hexadecimal digits have no
keyword: of a run of 24 digits at least six of every fourth character are digits, so every fourth
character is read, and the expression is tried around six of them in a row.

Tokens with a checksum inside (kinds ``github`` and ``npm``: a prefix, 30 characters, and their CRC-32
as six digits of base 62) are reported where the checksum holds.
"""

from __future__ import annotations

import functools
import re
import zlib
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, trimmed

#: Kinds in the order of reports, their patterns and the least length of what is kept.
BASE, CHECKED = ("assign", "access", "hex"), ("github", "npm")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS_PREFIX = "AKIA"
CHECKED_PREFIXES = {"github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "npm": ("npm_",)}
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
CHECKED_TOKEN = re.compile(r"(?:gh[pousr]|npm)_([0-9A-Za-z]+)")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
TOKEN_CHARS, SUM_CHARS = 36, 6
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

KINDS = (*BASE, *CHECKED)
_STRIDE = 4
_DENSE = re.compile(r"[0-9a-f]{%d,}" % (LEAST_HEX // _STRIDE))


@functools.cache
def automaton() -> ahocorasick.Automaton:
    """Keywords with their kind and length; those in either case in every spelling, so that a text is read as it is."""
    found = ahocorasick.Automaton()
    for word in ASSIGN_WORDS:
        for letters in product(*[sorted({c, c.upper()}) for c in word]):
            found.add_word("".join(letters), ("assign", len(word)))
    found.add_word(ACCESS_PREFIX, ("access", len(ACCESS_PREFIX)))
    for kind, prefixes in CHECKED_PREFIXES.items():
        for p in prefixes:
            found.add_word(p, (kind, len(p)))
    found.make_automaton()
    return found


def checksum_holds(token: str) -> bool:
    """Whether the last six characters are the CRC-32 of those before, in base 62."""
    value = 0
    for c in token[-SUM_CHARS:]:
        value = value * len(DIGITS) + DIGITS.index(c)
    return value == zlib.crc32(token[:-SUM_CHARS].encode())


def _kept(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m.group(2)) >= LEAST_VALUE
    if kind == "access":
        return m.end() - m.start() >= LEAST_ACCESS
    return len(m.group(1)) == TOKEN_CHARS and checksum_holds(m.group(1))


def hex_runs(text: str) -> list[tuple[int, int]]:
    """Runs of at least LEAST_HEX hexadecimal digits."""
    out = []
    for near in _DENSE.finditer(text[::_STRIDE]):
        first, last = max(0, _STRIDE * (near.start() - 1) + 1), min(len(text), _STRIDE * near.end())
        out += [m.span() for m in HEX.finditer(text, first, last) if m.end() - m.start() >= LEAST_HEX]
    return out


def spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) in code points, by start and then kind in the order of KINDS."""
    hits: dict[str, list[int]] = {}
    for end, (kind, length) in automaton().iter(text):
        hits.setdefault(kind, []).append(end + 1 - length)
    found = [(start, "hex", end) for start, end in hex_runs(text)]
    for kind, starts in hits.items():
        pattern, free = {"assign": ASSIGN, "access": ACCESS}.get(kind, CHECKED_TOKEN), 0
        for start in sorted(starts):  # hits come by their ends
            m = pattern.match(text, start) if start >= free else None
            if m:
                free = m.end()
                if _kept(kind, m):
                    found.append((start, kind, m.end()))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): spans of every row, an array of (kind, start, stop). Texts meet Python one by one, and nothing is shuffled."""

    def run(batches):
        for batch in slices(batches):
            texts = batch.column(1)
            rows = [spans(texts[i].as_py() or "") for i in range(batch.num_rows)]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
            held = pa.array([[{"kind": k, "start": a, "stop": z} for a, k, z in r] for r in rows], kind)
            yield pa.record_batch([batch.column(0), held], names=["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(trimmed(run), "doc_id long, spans array<struct<kind: string, start: bigint, stop: bigint>>")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_checked): counts of every row's secrets and their places.

    Null and empty texts have none. Rows are judged alone, so repeated rows, ties and null doc_ids are
    reported as they come; an empty table gives none, other columns are never read. A text of any
    length is read whole, in time that grows with its length.
    """
    of = lambda kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    n = lambda *kinds: F.size(of(kinds)).cast("long")
    return find(docs).select("doc_id", *[n(k).alias(f"n_{k}") for k in BASE], F.sha2(listed(of(BASE)), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), n(*CHECKED).alias("n_checked"))
