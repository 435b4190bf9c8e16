"""Language-model scores by context-tree weighting.

A text is its bytes, A-Z lowered, and an end mark. Every byte is eight binary
choices; each choice has its own tree over the ``DEPTH`` bytes before it. A node
of a tree holds how often its choice was 0 and 1 in training, and the
Krichevsky-Trofimov estimate from that. Weighting mixes, at every node, its own
estimate and what its children say, half and half before any data; so all depths
take part, each by how well it has coded the training text. The score is the
log10 probability of the text, the code length its base-2 negative.

Counts and probabilities meet the texts by shards (see ``blocks``): a block sends
each distinct group of ``DEPTH + 1`` bytes and each distinct word once, with its
count in training documents. Shards add up; then the trees are weighted from the
leaves to the root. All contexts that end in one byte form one subtree, at most
256 ** DEPTH leaves whatever the corpus; the roots are one small table. Nothing
whole is broadcast or collected.

Defined results: null and empty texts are the end mark alone; documents that may
not be learned from only get scores; without training documents every choice is
even and N is 0; groups never seen in training are scored too; texts are read
whole; repeated rows are documents of their own; an empty table gives an empty
table; columns besides the two named ones never matter. Words are told apart by
a 128-bit hash.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.blocks import Block, pack, per_row, per_shard, shards_for, sum_of, together
from folioflow.session import materialize

DEPTH = 3
#: No UTF-8 text holds this byte: ends a text and stands before its start.
MARK = 0xFF
#: Distinct groups or words, per block, that one shard gets.
SHARD_ENTRIES = 1 << 19


def held_out(key: int | None, parts: int = 7, part: int = 2) -> bool:
    """Documents never learned from, by a checksum of the key; without a key a document is not held out."""
    return key is not None and zlib.crc32(str(key).encode()) % parts == part


def grams(text: bytes):
    """For each byte of the text and its end: the DEPTH bytes before it and itself, as one number."""
    import numpy as np

    raw = np.frombuffer(bytes([MARK] * DEPTH) + text.lower() + bytes([MARK]), np.uint8).astype(np.uint32)
    n = len(text) + 1
    out = np.zeros(n, dtype=np.uint32)
    for k in range(DEPTH + 1):
        out = out << np.uint32(8) | raw[k:k + n]
    return out


def _last(gram):
    """The byte before the coded one: names the subtree."""
    return gram >> 8 & 0xFF


#: Cells of the table that numbers groups; more are sorted.
_TABLE = 1 << 22
#: Groups that are numbered at a time: what they need beside the table stays small.
_PART = 1 << 18


def _numbered(flat, out=None):
    """Distinct groups, ascending, and for each place the number of its group.

    A table over the occurring halves of the groups does it without sorting.
    ``out`` takes the numbers; it may be ``flat`` itself, seen as int32.
    """
    import numpy as np

    out = np.empty(len(flat), dtype=np.int32) if out is None else out
    parts = [slice(a, a + _PART) for a in range(0, len(flat), _PART)]
    tops, bottoms = np.zeros(65536, dtype=bool), np.zeros(65536, dtype=bool)
    for part in parts:
        tops[flat[part] >> np.uint32(16)], bottoms[flat[part] & np.uint32(0xFFFF)] = True, True
    rows, columns = np.flatnonzero(tops), np.flatnonzero(bottoms)
    if len(rows) * len(columns) > _TABLE:
        found = np.unique(np.concatenate([np.unique(flat[part]) for part in parts]))
        for part in parts:
            out[part] = np.searchsorted(found, flat[part])
        return found, out
    row_of = ((np.cumsum(tops) - 1) * len(columns)).astype(np.int32)
    column_of = (np.cumsum(bottoms) - 1).astype(np.int32)

    def cells_of(part):
        return row_of[flat[part] >> np.uint32(16)] + column_of[flat[part] & np.uint32(0xFFFF)]

    seen = np.zeros(max(1, len(rows) * len(columns)), dtype=bool)
    for part in parts:
        seen[cells_of(part)] = True
    cells = np.flatnonzero(seen)
    rank = np.empty(len(seen), dtype=np.int32)
    rank[cells] = np.arange(len(cells), dtype=np.int32)
    for part in parts:
        out[part] = rank[cells_of(part)]
    found = rows[cells // max(1, len(columns))] << 16 | columns[cells % max(1, len(columns))] if len(cells) else cells
    return found.astype(np.uint32), out


class _Seen:
    """Distinct groups and words of a block, and where its documents use them."""

    def __init__(self, row: dict, learned: Callable[[int | None], bool]):
        import numpy as np
        import xxhash

        block = Block(row)
        self.block, self.keys = block.block, block.keys
        self.learned = np.array([learned(k) for k in block.keys], dtype=bool)
        number: dict[bytes, int] = {}
        give = number.setdefault
        spots, self.word_ends, self.gram_ends = [], [0], [0]
        flat = np.empty(len(block.data) + len(block.keys), dtype=np.uint32)
        for text in block.texts():
            tokens = text.lower().split()
            spots.append(np.array([give(w, len(number)) for w in tokens], dtype=np.int32))
            self.word_ends.append(self.word_ends[-1] + len(tokens))
            end = self.gram_ends[-1] + len(text) + 1
            flat[self.gram_ends[-1]:end] = grams(text)
            self.gram_ends.append(end)
        self.word_at = np.concatenate(spots) if spots else np.zeros(0, np.int32)
        digests = b"".join(map(xxhash.xxh3_128_digest, number))
        del spots, number, give  # the objects go before the groups are numbered
        halves = np.frombuffer(digests, ">u8").reshape(-1, 2)
        order = np.lexsort((halves[:, 1], halves[:, 0]))
        self.hashes = halves[order]
        place = np.empty(len(order), dtype=np.int32)
        place[order] = np.arange(len(order))
        self.word_at = place[self.word_at]
        self.grams, self.gram_at = _numbered(flat, flat.view(np.int32))

    @staticmethod
    def per_document(values, at, ends) -> list:
        """Each document's sum of the values it uses."""
        return [values[at[a:b]].sum() for a, b in zip(ends, ends[1:])]

    def trained(self, at, ends, size: int):
        """How often training documents use each distinct thing."""
        import numpy as np

        total = np.zeros(size, dtype=np.int64)
        for learned, a, b in zip(self.learned, ends, ends[1:]):
            if learned:
                np.add.at(total, at[a:b], 1)
        return total


_MESSAGE = "kind string, shard int, block long, what binary, counts binary"


def _shard_of_gram(values, shards: int):
    """Scattered over the shards: neighbours in the alphabet are not."""
    import numpy as np

    return (values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(shards)


def _gram_parts(values, shards: int):
    """For each shard the places of its groups, ascending."""
    import numpy as np

    shard = _shard_of_gram(values, shards)
    order = np.argsort(shard, kind="stable")
    return np.split(order, np.searchsorted(shard[order], np.arange(1, shards)))


def _word_cuts(hashes: list[bytes], shards: int) -> list[int]:
    import bisect

    return [0, *(bisect.bisect_left(hashes, ((s << 128) // shards).to_bytes(16, "big")) for s in range(1, shards)),
            len(hashes)]


def _summaries(blocks: DataFrame, learned) -> DataFrame:
    """Distinct groups and words of each block with their training counts, and how many documents train."""

    def one(row: dict) -> Iterator[dict]:
        seen = _Seen(row, learned)
        g = seen.trained(seen.gram_at, seen.gram_ends, len(seen.grams))
        w = seen.trained(seen.word_at, seen.word_ends, len(seen.hashes))
        yield {"block": seen.block, "n_grams": len(seen.grams), "n_words": len(seen.hashes),
               "training": int(seen.learned.sum()), "grams": seen.grams.tobytes(), "gram_counts": g.tobytes(),
               "words": seen.hashes.tobytes(), "word_counts": w.tobytes()}

    return per_row(blocks, one, "block long, n_grams long, n_words long, training long, grams binary, "
                                "gram_counts binary, words binary, word_counts binary")


def _messages(summaries: DataFrame, gram_shards: int, word_shards: int) -> DataFrame:
    import numpy as np

    def one(row: dict) -> Iterator[dict]:
        values = np.frombuffer(row["grams"], np.uint32)
        counts = np.frombuffer(row["gram_counts"], np.int64)
        for shard, at in enumerate(_gram_parts(values, gram_shards)):
            if len(at):
                yield {"kind": "gram", "shard": shard, "block": row["block"], "what": values[at].tobytes(),
                       "counts": counts[at].tobytes()}
        words = row["words"]
        cuts = _word_cuts([words[i:i + 16] for i in range(0, len(words), 16)], word_shards)
        for shard, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if a < b:
                yield {"kind": "word", "shard": shard, "block": row["block"], "what": words[16 * a:16 * b],
                       "counts": row["word_counts"][8 * a:8 * b]}

    return per_row(summaries, one, _MESSAGE)


def _counted_grams(rows: list[dict]) -> Iterator[dict]:
    """One shard's distinct groups with their training counts over all blocks."""
    import numpy as np

    what = np.frombuffer(b"".join(r["what"] for r in rows), np.uint32)
    counts = np.frombuffer(b"".join(r["counts"] for r in rows), np.int64)
    order = np.argsort(what, kind="stable")
    what, counts = what[order], counts[order]
    starts = np.flatnonzero(np.r_[True, what[1:] != what[:-1]])
    yield {"shard": rows[0]["shard"], "what": what[starts].tobytes(), "counts": np.add.reduceat(counts, starts).tobytes()}


def _answered_words(rows: list[dict]) -> Iterator[dict]:
    """Each block's words of one shard with their training counts over all blocks, and the shard's totals."""
    import numpy as np

    halves = np.frombuffer(b"".join(r["what"] for r in rows), ">u8").astype(np.uint64).reshape(-1, 2)
    counts = np.frombuffer(b"".join(r["counts"] for r in rows), np.int64)
    order = np.lexsort((halves[:, 1], halves[:, 0]))
    ordered = halves[order]
    starts = np.flatnonzero(np.r_[True, (ordered[1:] != ordered[:-1]).any(axis=1)])
    total = np.add.reduceat(counts[order], starts)
    shared = np.empty(len(order), dtype=np.int64)
    shared[order] = np.repeat(total, np.diff(np.r_[starts, len(order)]))
    at = 0
    for row in rows:
        n = len(row["what"]) // 16
        yield {"kind": "word", "shard": row["shard"], "block": row["block"], "values": shared[at:at + n].tobytes(),
               "used": 0, "distinct": 0}
        at += n
    yield {"kind": "total", "shard": rows[0]["shard"], "block": None, "values": None, "used": int(total.sum()),
           "distinct": int((total > 0).sum())}


def _log_kt(zeros, ones):
    """Log of the Krichevsky-Trofimov block probability."""
    import numpy as np

    lg = np.frompyfunc(math.lgamma, 1, 1)
    both = zeros + ones

    def of(n):
        values, at = np.unique(n, return_inverse=True)
        return lg(values + 0.5).astype(np.float64)[at]

    def fact(n):
        values, at = np.unique(n, return_inverse=True)
        return lg(values + 1.0).astype(np.float64)[at]

    return of(zeros) + of(ones) - 2 * math.lgamma(0.5) - fact(both)


class Subtree:
    """All nodes whose context ends in one byte, weighted from the leaves; one of the eight choices at a time."""

    def __init__(self, values, counts):
        import numpy as np

        self.values, self.counts = values.astype(np.int64), counts
        self.symbol = self.values & 0xFF

    def levels(self, bit: int) -> Iterator[tuple]:
        """From depth DEPTH down to 1: nodes, each group's node, zeros, ones, own and weighted log probability."""
        import numpy as np

        prefix = (1 << bit) | self.symbol >> (8 - bit)
        chosen = self.symbol >> (7 - bit) & 1
        deeper = below = None
        for depth in range(DEPTH, 0, -1):
            context = self.values >> 8 & (1 << 8 * depth) - 1
            node, at = np.unique(context << 8 | prefix, return_inverse=True)
            ones = np.bincount(at, self.counts * chosen, len(node))
            zeros = np.bincount(at, self.counts * (1 - chosen), len(node))
            kt = _log_kt(zeros, ones)
            weighted = kt
            if below is not None:  # a child drops its oldest byte to become its parent
                up = np.searchsorted(node, (deeper >> 8 & (1 << 8 * depth) - 1) << 8 | deeper & 0xFF)
                weighted = np.logaddexp(kt, np.bincount(up, below, len(node))) - math.log(2)
            yield node, at, zeros, ones, kt, weighted
            deeper, below = node, weighted

    def to_root(self):
        """The subtree's weighted log probability, by choice node (255 of them)."""
        import numpy as np

        out = np.zeros(256)
        for bit in range(8):
            *_, (node, _, _, _, _, weighted) = self.levels(bit)
            out[node & 0xFF] = weighted
        return out

    def log10(self, root_share, root_one):
        """log10 probability of each group's byte. root_*: by choice node, weight and estimate at depth 0."""
        import numpy as np

        total = np.zeros(len(self.values))
        for bit in range(8):
            chosen = (self.symbol >> (7 - bit) & 1).astype(bool)
            p = None
            for _, at, zeros, ones, kt, weighted in self.levels(bit):
                own = (np.where(chosen, ones[at], zeros[at]) + 0.5) / (zeros[at] + ones[at] + 1)
                if p is None:
                    p = own
                else:
                    share = np.exp(kt - math.log(2) - weighted)[at]
                    p = share * own + (1 - share) * p
            node = (1 << bit) | self.symbol >> (8 - bit)
            own = np.where(chosen, root_one[node], 1 - root_one[node])
            p = root_share[node] * own + (1 - root_share[node]) * p
            total += np.log10(p)
        return total


def _roots(counted: DataFrame) -> tuple:
    """Weight and estimate of each choice node at depth 0, from one short row per subtree."""
    import numpy as np

    def one(rows: list[dict]) -> Iterator[dict]:
        values = np.frombuffer(b"".join(r["what"] for r in rows), np.uint32)
        counts = np.frombuffer(b"".join(r["counts"] for r in rows), np.int64)
        order = np.argsort(values)
        tree = Subtree(values[order], counts[order])
        by_symbol = np.bincount(values & 0xFF, counts, 256)
        yield {"weights": tree.to_root().tolist(), "symbols": by_symbol.tolist()}

    rows = per_shard(counted, one, "weights array<double>, symbols array<double>", by="last").collect()  # at most 256
    weights, symbols = np.zeros(256), np.zeros(256)
    for r in rows:
        weights += r.weights
        symbols += r.symbols
    zeros, ones = np.zeros(256), np.zeros(256)
    for s in range(256):
        for bit in range(8):
            node = (1 << bit) | s >> (8 - bit)
            (ones if s >> (7 - bit) & 1 else zeros)[node] += symbols[s]
    kt = _log_kt(zeros, ones)
    share = np.exp(kt - np.logaddexp(kt, weights))
    return share, (ones + 0.5) / (zeros + ones + 1)


def _by_subtree(counted: DataFrame) -> DataFrame:
    """The shards' groups dealt to subtrees: (last, shard, what, counts)."""
    import numpy as np

    def one(row: dict) -> Iterator[dict]:
        values = np.frombuffer(row["what"], np.uint32)
        counts = np.frombuffer(row["counts"], np.int64)
        last = _last(values)
        order = np.argsort(last, kind="stable")
        edges = np.searchsorted(last[order], np.arange(257))
        for byte in range(256):
            at = order[edges[byte]:edges[byte + 1]]
            if len(at):
                yield {"last": byte, "shard": row["shard"], "what": values[at].tobytes(), "counts": counts[at].tobytes()}

    return per_row(counted, one, "last int, shard int, what binary, counts binary")


def _probabilities(counted: DataFrame, roots: tuple, shards: int) -> DataFrame:
    """(kind, shard, what, values): log10 probability of every group, back by shard."""
    import numpy as np

    shipped = counted.sparkSession.sparkContext.broadcast(roots)  # twice 256 numbers

    def one(rows: list[dict]) -> Iterator[dict]:
        values = np.frombuffer(b"".join(r["what"] for r in rows), np.uint32)
        counts = np.frombuffer(b"".join(r["counts"] for r in rows), np.int64)
        order = np.argsort(values)
        values = values[order]
        logs = Subtree(values, counts[order]).log10(*shipped.value)
        for shard, at in enumerate(_gram_parts(values, shards)):
            if len(at):
                yield {"shard": shard, "what": values[at].tobytes(), "values": logs[at].tobytes()}

    return per_shard(counted, one, "shard int, what binary, values binary", by="last")


def _answer_grams(asked: list[dict], known: list[dict]) -> Iterator[dict]:
    import numpy as np

    values = np.frombuffer(b"".join(r["what"] for r in known), np.uint32)
    logs = np.frombuffer(b"".join(r["values"] for r in known), np.float64)
    order = np.argsort(values)
    values, logs = values[order], logs[order]
    for row in asked:
        at = np.searchsorted(values, np.frombuffer(row["what"], np.uint32))
        yield {"kind": "gram", "shard": row["shard"], "block": row["block"], "values": logs[at].tobytes()}


_ANSWER = "kind string, shard int, block long, values binary"


def scores(docs: DataFrame, key: str = "doc_id", text: str = "text",
           learned: Callable[[int | None], bool] = lambda k: not held_out(k)) -> DataFrame:
    """(key, learned, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte), a row per row."""
    import numpy as np

    blocks = pack(docs, key, text, "score-blocks", 5 << 20)
    summaries = materialize(_summaries(blocks, learned), "score-counts")
    gram_shards = shards_for(sum_of(summaries, "n_grams"), SHARD_ENTRIES)
    word_shards = shards_for(sum_of(summaries, "n_words"), SHARD_ENTRIES)
    training = sum_of(summaries, "training")
    messages = _messages(summaries, gram_shards, word_shards)
    asked = {k: messages.where(F.col("kind") == k) for k in ("gram", "word")}
    words = materialize(per_shard(asked["word"], _answered_words, f"{_ANSWER}, used long, distinct long"), "score-words")
    counted = per_shard(asked["gram"], _counted_grams, "shard int, what binary, counts binary")
    subtrees = materialize(_by_subtree(counted), "score-subtrees")
    logs = _probabilities(subtrees, _roots(subtrees), gram_shards)
    answers = together(asked["gram"].select("shard", "block", "what"), logs, "shard", _answer_grams, _ANSWER).union(
        words.where("kind = 'word'").select("kind", "shard", "block", "values"))
    n = sum_of(words, "used") + training  # an end per training document
    v = sum_of(words, "distinct") + (training > 0)
    unit = math.log10(n + v + 1)

    def one(own: list[dict], got: list[dict]) -> Iterator[dict]:
        said = {(r["kind"], r["shard"]): r["values"] for r in got}
        for row in own:
            seen = _Seen(row, learned)
            logs = np.empty(len(seen.grams))
            for shard, at in enumerate(_gram_parts(seen.grams, gram_shards)):
                if len(at):
                    logs[at] = np.frombuffer(said["gram", shard], np.float64)
            counts = np.frombuffer(b"".join(said.get(("word", s), b"") for s in range(word_shards)), np.int64)
            score = seen.per_document(logs, seen.gram_at, seen.gram_ends)
            base = seen.per_document(np.log10(counts + 1.0) - unit, seen.word_at, seen.word_ends)
            known = seen.per_document(counts > 0, seen.word_at, seen.word_ends)
            tokens, sizes = np.diff(seen.word_ends), np.diff(seen.gram_ends)
            end = math.log10(training + 1) - unit
            for i, name in enumerate(seen.keys):
                yield {"_key": name, "learned": bool(seen.learned[i]), "n_tokens": int(tokens[i]) + 1,
                       "n_known": int(known[i]) + (training > 0), "train_tokens": n,
                       "base_score": float(base[i] + end), "score": float(score[i]),
                       "bits_per_byte": float(-score[i] / math.log10(2) / sizes[i])}

    return together(blocks, answers, "block", one,
                    "_key long, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
                    "score double, bits_per_byte double").withColumnRenamed("_key", key)
