"""The operators' results by their definitions, in plain Python."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import xxhash

LOWER = {c: c + 32 for c in range(65, 91)}
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def line_dedup(texts: dict[int, str | None]) -> dict[int, tuple[int, str]]:
    """doc_id -> (dropped, kept text)."""
    holders: dict[str, set[int]] = {}
    rows = {d: (t or "").split("\n") for d, t in texts.items()}
    key = {x: x.strip(" \t\n\v\f\r").translate(LOWER) for r in rows.values() for x in r}
    for d, lines in rows.items():
        for x in lines:
            if len(key[x]) >= 20:
                holders.setdefault(key[x], set()).add(d)
    keeper = {k: max(h) for k, h in holders.items() if len(h) >= 3}
    out = {}
    for d, lines in rows.items():
        kept = [x for x in lines if keeper.get(key[x], d) == d]
        out[d] = len(lines) - len(kept), "\n".join(kept)
    return out


def fingerprint(text: str | None) -> int:
    words = WORD.findall((text or "").translate(LOWER))
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if ones[b] * 2 > len(grams))


def groups(prints: dict[int, int]) -> dict[int, int]:
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = np.array([prints[i] for i in ids], dtype=np.uint64)
    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(values[k + 1:] ^ values[k]) <= 3):
            a, b = find(i), find(ids[k + 1 + j])
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def bench_hits(texts: dict[int, str | None], items: dict[int, str | None]) -> dict[int, tuple[int, int, list[str]]]:
    """doc_id -> (words, hit words, item ids as sorted strings)."""
    windows: dict[tuple, set[int]] = {}
    for item, text in items.items():
        words = BENCH_WORD.findall((text or "").translate(LOWER))
        n = min(10, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[i:i + n]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = {}
    for d, text in texts.items():
        words = BENCH_WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                own = windows.get(tuple(words[i:i + n]))
                if own:
                    hit.update(range(i, i + n))
                    found |= own
        out[d] = len(words), len(hit), sorted(map(str, found))
    return out


def substring_dedup(texts: dict[int, bytes], least: int = 50) -> dict[int, tuple[int, int, bytes]]:
    """doc_id -> (removed bytes, runs, kept bytes)."""
    first: dict[bytes, int] = {}
    out = {}
    for d in sorted(texts):
        b = texts[d]
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - least + 1):
            if first.setdefault(b[i:i + least], d) < d:
                gone[i:i + least] = True
        runs = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        out[d] = int(gone.sum()), runs, np.frombuffer(b, np.uint8)[~gone].tobytes()
    return out


def held_out(key: int, parts: int) -> bool:
    return zlib.crc32(str(key).encode()) % parts == 2
