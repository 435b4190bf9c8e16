"""Line dedup against a sharded minimal perfect hash.

Lines are known by a 128-bit hash of their key (ends stripped, A-Z lowered).
Distinct hashes that more than one document holds are dealt to shards; a shard's
minimal perfect hash gives each a slot in three compact arrays: fingerprint,
document count (up to the number that matters) and largest document. Hashes held
once are left out: they can't reach any threshold, and the fingerprint tells a
stranger. Documents probe the arrays with the hashes of their block, each asked
once however many documents hold the line; lines are never joined.

Defined results: every row is a document of its own, so repeated rows count as
several and share the largest id; a null key is smaller than any other; null and
empty texts are one empty line, which is too short to go; among equal lines of
the keeping document all stay; texts are read whole; an empty table gives an
empty table; columns besides the two named ones never matter. Two different
lines with one 128-bit hash would be taken as one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame

from folioflow.llm.blocks import Block, pack, per_row, per_shard, shards_for, sum_of, together
from folioflow.session import materialize

MIN_CHARS = 20
MIN_DOCS = 3
#: Distinct hashes (per block) that one shard gets.
SHARD_ENTRIES = 1 << 18
#: Bits per key of a level of the perfect hash.
GAMMA = 2
LEVELS = 24


def line_keys(text: bytes, min_chars: int = MIN_CHARS) -> tuple[list[bytes], list[bytes | None]]:
    """The lines of a text, and the 128-bit hash of each that is long enough."""
    import xxhash

    lines = text.split(b"\n")
    hashes: list[bytes | None] = []
    for line in lines:
        key = line.strip().lower()  # bytes: only \x20 and \x09-\x0D go, only A-Z change
        if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8")) < min_chars:
            hashes.append(None)
        else:
            hashes.append(xxhash.xxh3_128_digest(key))
    return lines, hashes


def _mixed(low, level: int):
    """Independent hashes of the low halves, one per level."""
    import numpy as np

    x = low ^ np.uint64(0x9E3779B97F4A7C15 * (2 * level + 1) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class PerfectHash:
    """Slots 0..n-1 for n keys (high, low), from bit arrays: a key sits at the first level where it is alone.

    Keys still crowded after the last level are listed and found by bisection.
    """

    def __init__(self, bits: list, rest):
        import numpy as np

        self.bits, self.rest = bits, rest
        counts = [np.concatenate([[0], np.cumsum(b)]) for b in bits]
        before = np.concatenate([[0], np.cumsum([c[-1] for c in counts])]).astype(np.int64)
        self.ranks = [c + o for c, o in zip(counts, before)]
        self.placed = int(before[-1])

    @classmethod
    def build(cls, high, low) -> PerfectHash:
        import numpy as np

        bits, left = [], np.arange(len(low))
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(64, GAMMA * len(left))
            at = (_mixed(low[left], level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            bits.append(alone)
            left = left[~alone[at]]
        rest = np.array(sorted(zip(high[left].tolist(), low[left].tolist())), dtype=np.uint64).reshape(-1, 2)
        return cls(bits, rest)

    def slots(self, high, low):
        """The slot of each key; strangers get any slot, or -1."""
        import numpy as np

        out = np.full(len(low), -1, dtype=np.int64)
        left = np.arange(len(low))
        for level, (bits, ranks) in enumerate(zip(self.bits, self.ranks)):
            at = (_mixed(low[left], level) % np.uint64(len(bits))).astype(np.int64)
            here = bits[at]
            out[left[here]] = ranks[at[here]]
            left = left[~here]
        listed = {(h, x): i for i, (h, x) in enumerate(self.rest.tolist())}
        if listed:
            for i in left.tolist():
                out[i] = listed.get((int(high[i]), int(low[i])), -1 - self.placed) + self.placed
        return out

    def to_row(self) -> dict:
        import numpy as np

        return {"sizes": [len(b) for b in self.bits], "bits": [np.packbits(b).tobytes() for b in self.bits],
                "rest": self.rest.tobytes()}

    @classmethod
    def from_row(cls, row: dict) -> PerfectHash:
        import numpy as np

        bits = [np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool)
                for b, n in zip(row["bits"], row["sizes"])]
        return cls(bits, np.frombuffer(row["rest"], np.uint64).reshape(-1, 2))


_QUESTION = "shard int, block long, hashes binary, docs binary, largest binary"
_INDEX = ("shard int, sizes array<long>, bits array<binary>, rest binary, fingerprints binary, counts binary, "
          "largest binary")


def _pairs(data: bytes):
    import numpy as np

    both = np.frombuffer(data, dtype=">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _summaries(blocks: DataFrame, min_chars: int) -> DataFrame:
    """(block, n, hashes, docs, largest): the distinct hashes of a block, who holds them."""
    import numpy as np

    def one(row: dict) -> Iterator[dict]:
        block = Block(row)
        docs: dict[bytes, int] = {}
        largest: dict[bytes, int] = {}
        for number, text in zip(block.ids.tolist(), block.texts()):
            for h in set(line_keys(text, min_chars)[1]):
                if h is not None:
                    docs[h] = docs.get(h, 0) + 1
                    largest[h] = max(largest.get(h, number), number)
        order = sorted(docs)
        yield {"block": block.block, "n": len(order), "hashes": b"".join(order),
               "docs": np.array([docs[h] for h in order], np.int64).tobytes(),
               "largest": np.array([largest[h] for h in order], np.int64).tobytes()}

    return per_row(blocks, one, "block long, n long, hashes binary, docs binary, largest binary")


def _questions(summaries: DataFrame, shards: int) -> DataFrame:
    """A packed row per block and shard; hashes are sorted, so shards are ranges of the high half."""
    import numpy as np

    def one(row: dict) -> Iterator[dict]:
        high, _ = _pairs(row["hashes"])
        cuts = np.searchsorted(high, [(s << 64) // shards for s in range(1, shards)]) if shards > 1 else []
        edges = [0, *map(int, cuts), len(high)]
        for shard, (a, b) in enumerate(zip(edges, edges[1:])):
            if a < b:
                yield {"shard": shard, "block": row["block"], "hashes": row["hashes"][16 * a:16 * b],
                       "docs": row["docs"][8 * a:8 * b], "largest": row["largest"][8 * a:8 * b]}

    return per_row(summaries, one, _QUESTION)


def build_index(questions: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """A row per shard: its perfect hash, and fingerprint, count and largest document by slot."""
    import numpy as np

    def one(rows: list[dict]) -> Iterator[dict]:
        high, low = _pairs(b"".join(r["hashes"] for r in rows))
        docs = np.frombuffer(b"".join(r["docs"] for r in rows), np.int64)
        largest = np.frombuffer(b"".join(r["largest"] for r in rows), np.int64)
        order = np.lexsort((low, high))
        high, low, docs, largest = high[order], low[order], docs[order], largest[order]
        starts = np.flatnonzero(np.r_[True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])])
        docs, largest = np.add.reduceat(docs, starts), np.maximum.reduceat(largest, starts)
        high, low = high[starts], low[starts]
        kept = docs >= min(2, min_docs)
        high, low, docs, largest = high[kept], low[kept], docs[kept], largest[kept]
        table = PerfectHash.build(high, low)
        slots = table.slots(high, low)
        prints, counts, last = np.empty_like(high), np.empty(len(high), np.uint16), np.empty_like(largest)
        prints[slots], counts[slots], last[slots] = high, np.minimum(docs, 65535), largest
        yield {"shard": rows[0]["shard"], **table.to_row(), "fingerprints": prints.tobytes(),
               "counts": counts.tobytes(), "largest": last.tobytes()}

    return per_shard(questions, one, _INDEX)


def probe_index(questions: DataFrame, index: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(block, hashes, largest): of what a block asked, the lines to drop and the document that keeps each."""
    import numpy as np

    def one(asked: list[dict], shard: list[dict]) -> Iterator[dict]:
        if not shard:
            return
        table = PerfectHash.from_row(shard[0])
        prints = np.frombuffer(shard[0]["fingerprints"], np.uint64)
        counts = np.frombuffer(shard[0]["counts"], np.uint16)
        largest = np.frombuffer(shard[0]["largest"], np.int64)
        for row in asked:
            high, low = _pairs(row["hashes"])
            slot = table.slots(high, low)
            known = np.flatnonzero(slot >= 0)
            known = known[prints[slot[known]] == high[known]]
            known = known[counts[slot[known]] >= min_docs]
            if len(known):
                yield {"block": row["block"], "largest": largest[slot[known]].tobytes(),
                       "hashes": b"".join(row["hashes"][16 * i:16 * i + 16] for i in known.tolist())}

    return together(questions.select("shard", "block", "hashes"), index, "shard", one,
                    "block long, hashes binary, largest binary")


def _applied(docs: DataFrame, key: str, text: str, min_chars: int, min_docs: int, row_of, schema, carry=False) -> DataFrame:
    """``row_of(block, place, lines, kept lines)`` for every document."""
    import numpy as np

    if not 1 <= min_docs <= 65535:
        raise ValueError("min_docs is 1 to 65535")
    blocks = pack(docs, key, text, "line-blocks", carry=carry)
    summaries = materialize(_summaries(blocks, min_chars), "line-hashes")
    shards = shards_for(sum_of(summaries, "n"), SHARD_ENTRIES)
    index = materialize(build_index(_questions(summaries, shards), min_docs), "line-index")
    answers = probe_index(_questions(summaries, shards), index, min_docs)

    def one(own: list[dict], got: list[dict]) -> Iterator[dict]:
        keeper: dict[bytes, int] = {}
        for row in got:
            last = np.frombuffer(row["largest"], np.int64).tolist()
            keeper.update((row["hashes"][16 * i:16 * i + 16], n) for i, n in enumerate(last))
        for row in own:
            block = Block(row)
            for i, (number, body) in enumerate(zip(block.ids.tolist(), block.texts())):
                lines, hashes = line_keys(body, min_chars)
                yield row_of(block, i, lines, [x for x, h in zip(lines, hashes) if keeper.get(h, number) == number])

    return together(blocks, answers, "block", one, schema)


def dedup_report(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS,
                 min_docs: int = MIN_DOCS) -> DataFrame:
    """(key, n_lines, n_dropped, kept_sha256), a row per row."""

    def row(block, i, lines, kept):
        return {"_key": block.keys[i], "n_lines": len(lines), "n_dropped": len(lines) - len(kept),
                "kept_sha256": hashlib.sha256(b"\n".join(kept)).hexdigest()}

    return _applied(docs, key, text, min_chars, min_docs, row,
                    "_key long, n_lines long, n_dropped long, kept_sha256 string").withColumnRenamed("_key", key)


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", size: str = "n_chars",
                min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents with shortened texts, all other columns as they were; null texts stay null.

    A column named ``size``, if there, is the text's length and is counted anew where lines went.
    """
    fields = docs.schema.names

    def row(block, i, lines, kept):
        rest = block.rest[i]
        out = dict(rest["row"])
        out[text] = None if rest["no_text"] else b"\n".join(kept).decode("utf-8")
        if len(kept) < len(lines) and size in out:
            out[size] = len(out[text])
        return {name: out[name] for name in fields}

    return _applied(docs, key, text, min_chars, min_docs, row, docs.schema, carry=True)
