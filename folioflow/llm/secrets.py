"""Secret scans: single patterns, and credentials that come in several parts.

Base findings are matches of fixed patterns. On top, identifiers, secret-looking
strings and endpoints are weak candidates: alone they mean nothing. An interval
join inside a scope (text between empty lines) looks for a part of another kind:
on another line of the scope at any distance, on the same line (which may be a
long paragraph) within ``REACH`` characters. A weak candidate is reported as
``linked`` only if one is there. Partners are found by bisection on sorted starts
and ends: the question is whether one exists, so no pairs are formed however many
parts a scope holds. Parts are of any length.

Defined results: a null or empty text has no findings; equal spans found by
several rules appear once per kind; offsets are code points, end exclusive; rows
are independent, so repeated keys give repeated rows; other columns never
matter; an empty table gives an empty table.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from folioflow.llm.rows import per_text

KINDS = ("assign", "access", "hex", "linked")
#: Most characters between complementary parts of one line.
REACH = 200
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII)
_ASSIGN_WORDS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
# weak parts: what names an account, what could be its secret, where it is used
_IDENTIFIER = re.compile(
    r"""(?:access_?key(?:_?id)?|client_?id|account(?:_?id)?|user(?:name)?|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""",
    re.IGNORECASE | re.ASCII)
_IDENTIFIER_WORDS = ("access", "client", "account", "user", "login")
_OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])")
_ENDPOINT = re.compile(
    r"(?:https?|postgres(?:ql)?|mysql|redis|mongodb(?:\+srv)?|amqps?|s3)://[^\s\"'<>]{3,}", re.ASCII)
_SCOPE = re.compile(r"\n[\t\r\x20]*\n")
_BREAK = re.compile(r"\n")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) of the single patterns, in order."""
    found = []
    lower = text.lower()
    if any(w in lower for w in _ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    found.sort()
    return found


def _varied(value: str) -> bool:
    """Letters and digits mixed, as in generated secrets and not in words."""
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and len(set(value)) >= 10


def linked_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Weak candidates that have a complementary part in their scope."""
    lower = text.lower()
    weak = {"id": [], "secret": [], "place": []}
    if any(w in lower for w in _IDENTIFIER_WORDS):
        weak["id"] = [(m.start(), m.end()) for m in _IDENTIFIER.finditer(text)]
    if "://" in text:
        weak["place"] = [(m.start(), m.end()) for m in _ENDPOINT.finditer(text)]
    strong_ids = [(s, e) for s, k, e in base if k == 1]
    strong_secrets = [(s, e) for s, k, e in base if k != 1]
    if not (weak["id"] or weak["place"] or strong_ids):
        return []  # nothing could complement a secret-looking string
    weak["secret"] = [m.span() for m in _OPAQUE.finditer(text) if _varied(m[0])]
    borders = [m.start() for m in _SCOPE.finditer(text)]
    breaks = [m.start() for m in _BREAK.finditer(text)]
    sides = {"id": strong_ids + weak["id"], "secret": strong_secrets + weak["secret"], "place": weak["place"]}
    starts = {k: sorted(s for s, _ in v) for k, v in sides.items()}
    ends = {k: sorted(e for _, e in v) for k, v in sides.items()}
    taken = {(s, e) for s, _, e in base}

    def around(cuts: list[int], at: int) -> tuple[int, int]:
        n = bisect.bisect_left(cuts, at)
        return cuts[n - 1] if n else -1, cuts[n] if n < len(cuts) else len(text)

    def meets(kind: str, start: int, end: int) -> bool:
        """No part holds a line break, so one that ends or starts in a line or scope lies in it."""
        own, other = starts[kind], ends[kind]
        scope, line = around(borders, start), around(breaks, start)
        n = bisect.bisect_right(other, start)
        if n and other[n - 1] > line[0] and other[n - 1] >= start - REACH:
            return True
        n = bisect.bisect_left(own, end)
        if n < len(own) and own[n] < line[1] and own[n] <= end + REACH:
            return True
        n = bisect.bisect_right(own, scope[0])  # the first and the last of the scope, if on another line
        if n < len(own) and own[n] < line[0]:
            return True
        n = bisect.bisect_left(own, scope[1])
        return n > 0 and own[n - 1] > line[1]

    kinds = set(weak)
    out = set()
    for kind, spans in weak.items():
        for s, e in spans:
            if (s, e) not in taken and any(meets(p, s, e) for p in kinds - {kind}):
                out.add((s, 3, e))
    return sorted(out)


def _scan() -> Callable[[str], tuple]:
    def one(text: str) -> tuple:
        base = base_spans(text)
        linked = linked_spans(text, base)
        said = [f"{KINDS[k]}:{s}:{e}" for s, k, e in base]
        digest = hashlib.sha256(",".join(said).encode()).hexdigest()
        spans = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(base + linked)) if linked else ",".join(said)
        counts = [sum(k == n for _, k, _ in base) for n in range(3)]
        return *counts, len(linked), digest, spans

    return one


def scan_secrets(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts per kind, digest of the base findings and all spans, a row per row; no shuffle."""
    return per_text(
        df, key, text, _scan, ["n_assign", "n_access", "n_hex", "n_linked", "base_sha256", "spans"],
        [pa.int64()] * 4 + [pa.string()] * 2,
        "n_assign long, n_access long, n_hex long, n_linked long, base_sha256 string, spans string")


def redact(df: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "[secret]") -> DataFrame:
    """(key, text) with every span, base or linked, replaced by ``mark``."""

    def one():
        def hide(t: str) -> tuple:
            base = base_spans(t)
            out, at = [], 0
            for s, _, e in sorted(base + linked_spans(t, base)):
                if s >= at:
                    out += [t[at:s], mark]
                at = max(at, e)
            return ("".join(out) + t[at:],)

        return hide

    return per_text(df, key, text, one, ["redacted"], [pa.string()], "redacted string")
