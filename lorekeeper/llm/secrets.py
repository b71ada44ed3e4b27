"""Secret scans with multipart credential linking."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

# The base patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

# Parts that alone are too weak to report.
_ID = re.compile(r"(?<![A-Za-z0-9])(?:(?:ASIA|AIDA|AROA|AGPA|ANPA)[A-Z0-9]{8,}|AKIA[A-Z0-9]{4,11}(?![A-Z0-9]))")
_NAMED_ID = re.compile(r"""(?:client|account|access)_?(?:key_?)?id["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.-]{6,})|(?<!//)\buser(?:name)?["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""", re.I | re.A)
_KEY = re.compile(r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])(?=[A-Za-z0-9+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/=_-])")
_SHORT_HEX = re.compile(r"(?<![0-9A-Za-z])(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{16,31}(?![0-9A-Za-z])")
#: A URL; its part is what is neither user-info nor query.
_ENDPOINT = re.compile(r"\b(?:https?|s3|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp)://(?:[^\s\"'<>/@?#]*@)?([^\s\"'<>?#]+)")

_ID_PREFIXES = ("ASIA", "AIDA", "AROA", "AGPA", "ANPA", "AKIA")
_ID_WORDS = ("keyid", "key_id", "clientid", "client_id", "accountid", "account_id", "accessid", "access_id", "user")

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "weak_id": "id", "weak_secret": "secret", "endpoint": "endpoint"}
#: A scope reaches this many code points before and after a part.
REACH = 200

Span = tuple[int, int, int]
_FOUND = pa.schema([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_linked", pa.int64())])


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the matches that hold on their own."""
    found: list[Span] = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    # Runs of hex digits are maximal, so asking for 32 at once finds the same ones.
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _weak_spans(text: str, base: list[Span]) -> list[Span]:
    found: list[Span] = []
    if any(p in text for p in _ID_PREFIXES):
        found += [(m.start(), 3, m.end()) for m in _ID.finditer(text)]
    if any(w in text.lower() for w in _ID_WORDS):
        found += [(m.start(), 3, m.end()) for m in _NAMED_ID.finditer(text)]
    if "://" in text:
        found += [(m.start(1) if "@" in m[0][: m.start(1) - m.start()] else m.start(), 5, m.end()) for m in _ENDPOINT.finditer(text)]
    found = _apart(found, base)
    if not found and not any(k == 1 for _, k, _ in base):
        return []  # parts of one role alone link with nothing
    keys = [(m.start(), 4, m.end()) for p in (_KEY, _SHORT_HEX) for m in p.finditer(text)]
    return sorted(found + _apart(keys, base + found))


def _apart(spans: list[Span], taken: list[Span]) -> list[Span]:
    """The spans that overlap none of those taken; both are sorted once."""
    ordered = sorted((s, e) for s, _, e in taken)
    starts = [s for s, _ in ordered]
    ends = list(accumulate((e for _, e in ordered), max))
    return [x for x in spans if not (i := bisect_left(starts, x[2])) or ends[i - 1] <= x[0]]


def linked_spans(text: str, base: list[Span], reach: int = REACH) -> list[Span]:
    """The weak parts that have a complementary part within their scope, which is never a part of the same span.

    A secret completes an identifier or an endpoint, and either of them a secret; without a
    secret nothing is reported, so an ordinary link is not.  An interval join: intervals of
    parts, widened by ``reach``, against the parts that complete them, both sorted; the
    nearest ones on either side decide, so a text with many parts takes no more than the time
    to sort them.
    """
    weak = _weak_spans(text, base)
    if not weak:
        return []
    sides = {}
    for secret in (False, True):
        parts = sorted((s, e) for s, k, e in base + weak if (ROLE[KINDS[k]] == "secret") == secret)
        sides[secret] = ([s for s, _ in parts], list(accumulate((e for _, e in parts), max)))
    linked = []
    for start, kind, end in weak:
        starts, ends = sides[ROLE[KINDS[kind]] != "secret"]
        i = bisect_left(starts, end + reach)
        if i and ends[i - 1] > start - reach:
            linked.append((start, kind, end))
    return linked


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            base = base_spans(text)
            linked = linked_spans(text, base)
            kinds = [k for _, k, _ in base]
            counts = {f"n_{KINDS[k]}": kinds.count(k) for k in range(3)}
            rows.append(counts | {"base_sha256": hashlib.sha256(_joined(base).encode()).hexdigest(), "spans": _joined(sorted(base + linked)), "n_linked": len(linked)})
        out = pa.RecordBatch.from_pylist(rows, schema=_FOUND)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *out.columns], ["doc_id", *_FOUND.names])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Counts and spans of secrets in every row of ``docs``.

    Base spans hold on their own.  Keys that are too weak alone are added when an identifier
    or endpoint lies within ``REACH`` code points, and these when a key or base secret does;
    parts that overlap a base span, and keys that overlap an identifier or the host and path
    of an endpoint, are no parts.  Positions are code points of the whole text,
    however long; a null text counts as empty and has no spans.  Repeated rows give
    repeated results; further columns are ignored.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long")
