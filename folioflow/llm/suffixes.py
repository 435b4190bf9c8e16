"""Exact substring dedup by sorting suffixes in range-partitioned buckets.

Sorting the suffix at every byte would move the text many times over. Any
``MIN_BYTES`` bytes contain ``GRAM``-byte groups; the one with the smallest hash is
an anchor, chosen by content alone, so equal strings have it at equal places.
Only suffixes at anchors are dealt out, about one in fourteen bytes:

1. Sampled splitters range-partition the anchors by their leading bytes (then a
   hash of the group). A bucket names those that more than one block holds.
2. For these, the text around (all strings of ``MIN_BYTES`` bytes anchored there)
   goes to the bucket of the anchor. The bucket sorts it eight bytes at a time,
   refining only what is still tied: a multikey quicksort with wide digits.
   Equal strings get the smallest document that holds them. An anchor's bucket is
   decided by its value, so no equal strings lie across a boundary; a splitter
   itself belongs to the bucket above. Of an anchor with more than ``HOT_STRINGS``
   strings (a frequent phrase in ever different text), counted per block without
   repeats, the strings go out one by one, each to a part of the anchor named by a
   hash of it: equal strings still meet, and no anchor has to fit into a task.
3. Blocks get back which of their strings start in a smaller document, and cut.

Hashes only choose candidates; bytes decide. A passage in a third of all documents
reaches its bucket once per block and text around it.

Defined results: null and empty texts have no bytes; texts shorter than
``MIN_BYTES`` stay; documents of one id (repeated rows) don't remove from each
other; a null key is smaller than any other; matches may cut UTF-8 characters,
so kept bytes are bytes; texts are whole; an empty table gives an empty table;
columns besides the two named ones never matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.blocks import Block, expand, pack, per_row, per_shard, shards_for, squeeze, together

MIN_BYTES = 50
GRAM = 24
#: Group starts in a string of MIN_BYTES: what an anchor is the least of.
SPAN = MIN_BYTES - GRAM + 1
#: Bytes looked at in one go.
PIECE = 1 << 20
#: Anchors, per block distinct, of one bucket.
BUCKET_ENTRIES = 1 << 19
#: Strings of one anchor, per block distinct, above which it is parted.
HOT_STRINGS = 1 << 20
#: Anchors sampled for the splitters: of each of about SAMPLE_BLOCKS blocks.
SAMPLE_ANCHORS, SAMPLE_BLOCKS = 4096, 48
_ODD = 0x9E3779B97F4A7C15


def _group_hashes(data):
    """A 64-bit hash of the GRAM bytes from each place on (places without so many are left out)."""
    import numpy as np

    def double(h, k: int):
        """From hashes of k bytes to hashes of 2k."""
        return h[:-k] * np.uint64(pow(_ODD, k, 2**64)) + h[k:]

    one = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    one ^= one >> np.uint64(29)
    eight = double(double(double(one, 1), 2), 4)
    sixteen = double(eight, 8)
    h = sixteen[:-8] * np.uint64(pow(_ODD, 8, 2**64)) + eight[16:]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _anchors(data, starts, ends):
    """Runs of strings with one anchor: first string's place, number of strings, anchor's place, anchor's hash.

    data: the bytes of a block; starts, ends: its texts. A string lies inside one text.
    """
    import numpy as np

    out = []
    for text_start, text_end in _stretches(starts, ends):
        at = text_start
        while text_end - at >= MIN_BYTES:
            upto = min(text_end, at + PIECE + MIN_BYTES - 1)
            h = _group_hashes(data[at:upto])
            low = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
            width, least = 1, low
            while 2 * width <= SPAN:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            if width < SPAN:
                least = np.minimum(least[: len(least) - (SPAN - width)], least[SPAN - width:])
            anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
            strings = np.arange(at, at + len(anchor))
            doc = np.searchsorted(ends, strings, side="right")
            inside = strings + MIN_BYTES <= ends[np.minimum(doc, len(ends) - 1)]
            strings, anchor, doc = strings[inside], anchor[inside], doc[inside]
            if len(strings):
                first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
                out.append((strings[first], np.diff(np.r_[first, len(strings)]), anchor[first] + at, h[anchor[first]]))
            at += PIECE
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    return tuple(np.concatenate(c) for c in zip(*out))


def _stretches(starts, ends):
    """The whole block at once: strings across texts are dropped afterwards."""
    return [(0, int(ends[-1]))] if len(ends) else []


def _anchor_keys(data, at, hashes):
    """Four leading bytes, then half a hash: sorts like the suffixes do."""
    import numpy as np

    lead = np.zeros(len(at), dtype=np.uint64)
    for k in range(4):
        lead = lead << np.uint64(8) | data[at + k].astype(np.uint64)
    return lead << np.uint64(32) | (hashes * np.uint64(_ODD)) >> np.uint64(32)


class _Runs:
    """A block with its anchors."""

    def __init__(self, row: dict):
        import numpy as np

        self.own = Block(row)
        self.data = np.frombuffer(self.own.data, np.uint8)
        self.first, self.count, self.at, hashes = _anchors(self.data, self.own.starts, self.own.ends)
        self.keys = _anchor_keys(self.data, self.at, hashes)
        self.doc = np.searchsorted(self.own.ends, self.first, side="right")


def _splitters(blocks: DataFrame):
    """Values that cut the anchors into buckets of about BUCKET_ENTRIES, from a bounded sample of blocks."""
    import numpy as np

    def one(row: dict) -> Iterator[dict]:
        keys = np.unique(_Runs(row).keys)
        some = keys[:: max(1, len(keys) // SAMPLE_ANCHORS)]
        yield {"n": len(keys), "sample": some.tobytes()}

    n = max(1, blocks.count())
    share = F.pmod(F.xxhash64("block"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, SAMPLE_BLOCKS / n))
    rows = per_row(blocks.where(share), one, "n long, sample binary").collect()
    # a block counts by its own number of anchors, whatever is taken of it
    sample = [np.frombuffer(r.sample, np.uint64) for r in rows]
    values = np.concatenate([np.zeros(0, np.uint64), *sample])
    weights = np.concatenate([np.zeros(0), *(np.full(len(v), r.n / max(1, len(v))) for v, r in zip(sample, rows))])
    total = weights.sum() * n / max(1, len(rows))
    buckets = shards_for(int(total), BUCKET_ENTRIES)
    if buckets == 1 or not len(values):
        return np.zeros(0, np.uint64)
    order = np.argsort(values)
    reached = np.cumsum(weights[order])
    at = np.searchsorted(reached, reached[-1] * np.arange(1, buckets) / buckets)
    return np.unique(values[order][at])


def _strings(runs: _Runs):
    """The distinct anchors of a block, ascending, and how many strings each has, equal surroundings counted once."""
    import numpy as np

    order = np.argsort(runs.keys, kind="stable")
    keys, counts = runs.keys[order], runs.count[order]
    if not len(keys):
        return keys, counts
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[start, len(keys)])
    again = np.flatnonzero(np.repeat(sizes > 1, sizes))
    some, data, seen = order[again], runs.own.data, set()
    fresh = np.ones(len(some), dtype=bool)
    firsts, offsets = runs.first[some], runs.at[some] - runs.first[some]
    for i, one in enumerate(zip(keys[again].tolist(), offsets.tolist(), firsts.tolist(), counts[again].tolist())):
        k, o, f, c = one
        around = (k, o, data[f:f + c + MIN_BYTES - 1])
        fresh[i] = around not in seen
        seen.add(around)
    counts[again[~fresh]] = 0
    return keys[start], np.add.reduceat(counts, start)


def _dealt(blocks: DataFrame, cuts) -> DataFrame:
    """The distinct anchors of each block, ascending, cut at the splitters."""
    import numpy as np

    def one(row: dict) -> Iterator[dict]:
        keys, strings = _strings(_Runs(row))
        edges = [0, *np.searchsorted(keys, cuts).tolist(), len(keys)]
        for bucket, (a, b) in enumerate(zip(edges, edges[1:])):
            if a < b:
                yield {"shard": bucket, "block": row["block"], "anchors": keys[a:b].tobytes(),
                       "strings": squeeze(strings[a:b].astype(np.uint32).tobytes())}

    return per_row(blocks, one, "shard int, block long, anchors binary, strings binary")


_SHARED = "block long, anchors binary, hot binary, parts binary"


def _shared(hot: int, part_strings: int):
    """Of the anchors each block sent, those that another block sent too; which are hot, and into how many parts."""
    import numpy as np

    def run(rows: list[dict]) -> Iterator[dict]:
        each = [np.frombuffer(r["anchors"], np.uint64) for r in rows]
        everything = np.sort(np.concatenate(each))
        several = np.unique(everything[1:][everything[1:] == everything[:-1]])
        total = np.zeros(len(several), dtype=np.int64)
        owned = []
        for row, keys in zip(rows, each):
            own = np.isin(keys, several, assume_unique=True)
            owned.append(np.searchsorted(several, keys[own]))
            total[owned[-1]] += np.frombuffer(expand(row["strings"]), np.uint32)[own]
        parts = np.where(total > hot, -(-total // part_strings), 0)
        for row, own in zip(rows, owned):
            if len(own):
                parted = own[parts[own] > 0]
                yield {"block": row["block"], "anchors": several[own].tobytes(), "hot": several[parted].tobytes(),
                       "parts": parts[parted].tobytes()}

    return run


_AROUND = ("shard int, block long, keys binary, offsets binary, counts binary, least binary, texts binary, "
           "owner binary, places binary, others binary")


def _around(cuts):
    """Around each anchor that several documents hold: its bytes, once per block, and where they stand."""
    import numpy as np
    import xxhash

    def sent(block, shard, key, offset, size, least, texts, seen, firsts, other) -> dict:
        steps = np.diff(seen, prepend=0).astype(np.int32)  # mostly 0 and 1
        return {"shard": shard, "block": block, "keys": key.tobytes(), "offsets": offset.tobytes(),
                "counts": size.tobytes(), "least": squeeze(least.tobytes()), "texts": squeeze(b"".join(texts)),
                "owner": squeeze(steps.tobytes()), "places": firsts.astype(np.uint32).tobytes(),
                "others": squeeze(other.tobytes())}

    def numbered(data, keys, offsets, firsts, counts, ids):
        """Distinct surroundings as columns; the number, and whether it is another document's, of each occurrence."""
        number: dict[tuple, int] = {}
        seen = np.array([number.setdefault((k, o, data[f:f + c + MIN_BYTES - 1]), len(number)) for k, o, f, c in zip(
            keys.tolist(), offsets.tolist(), firsts.tolist(), counts.tolist())], dtype=np.int64)
        least = np.full(len(number), np.iinfo(np.int64).max)
        np.minimum.at(least, seen, ids)
        key = np.array([k for k, _, _ in number], dtype=np.uint64)
        offset = np.array([o for _, o, _ in number], dtype=np.uint8)
        texts = [t for _, _, t in number]
        size = np.array([len(t) - MIN_BYTES + 1 for t in texts], dtype=np.uint8)
        return key, offset, size, least, texts, seen, (ids != least[seen]).astype(np.uint8)

    def one(own: list[dict], got: list[dict]) -> Iterator[dict]:
        wanted = np.sort(np.frombuffer(b"".join(r["anchors"] for r in got), np.uint64))
        hot = np.frombuffer(b"".join(r["hot"] for r in got), np.uint64)
        parts = np.frombuffer(b"".join(r["parts"] for r in got), np.int64)
        parts, hot = parts[np.argsort(hot)], np.sort(hot)
        for row in own:
            runs = _Runs(row)
            ids = runs.own.ids[runs.doc] if len(runs.doc) else runs.doc
            order = np.argsort(runs.keys, kind="stable")
            keys, who = runs.keys[order], ids[order]
            start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
            mixed = np.zeros(0, np.uint64)
            if len(start):
                mixed = keys[start[np.minimum.reduceat(who, start) != np.maximum.reduceat(who, start)]]
            parted = np.isin(keys, hot)
            chosen = order[(np.isin(keys, wanted) | np.isin(keys, mixed)) & ~parted]  # by key, then by place
            data = runs.own.data
            if len(chosen):
                firsts = runs.first[chosen]
                key, offset, size, least, texts, seen, other = numbered(
                    data, runs.keys[chosen], runs.at[chosen] - firsts, firsts, runs.count[chosen], ids[chosen])
                edges = [0, *np.searchsorted(key, cuts).tolist(), len(key)]
                spot_edges = np.searchsorted(runs.keys[chosen], cuts).tolist()
                spot_edges = [0, *spot_edges, len(chosen)]
                for bucket, (a, b, c, d) in enumerate(zip(edges, edges[1:], spot_edges, spot_edges[1:])):
                    if a < b:
                        yield sent(row["block"], bucket, key[a:b], offset[a:b], size[a:b], least[a:b], texts[a:b],
                                   seen[c:d] - a, firsts[c:d], other[c:d])
            chosen = order[parted]
            if len(chosen):  # string by string
                n = runs.count[chosen]
                chosen = np.repeat(chosen, n)
                firsts = runs.first[chosen] + np.arange(len(chosen)) - np.repeat(np.cumsum(n) - n, n)
                key, offset, size, least, texts, seen, other = numbered(
                    data, runs.keys[chosen], runs.at[chosen] - firsts, firsts, np.ones(len(chosen), np.int64), ids[chosen])
                part = np.array([xxhash.xxh64_intdigest(t, o) for t, o in zip(texts, offset.tolist())], dtype=np.uint64)
                part %= parts[np.searchsorted(hot, key)].astype(np.uint64)
                # below zero: no bucket; parts of different anchors may meet, which changes nothing
                shard = -1 - ((key * np.uint64(_ODD) >> np.uint64(34)) + part & np.uint64((1 << 30) - 1)).astype(np.int64)
                by_shard = np.argsort(shard, kind="stable")
                place = np.empty(len(key), dtype=np.int64)
                place[by_shard] = np.arange(len(key))
                spots = np.argsort(place[seen], kind="stable")
                found, edges = np.unique(shard[by_shard], return_index=True)
                edges = np.r_[edges, len(key)]
                spot_edges = np.searchsorted(place[seen][spots], edges)
                for at, number in enumerate(found.tolist()):
                    mine, here = by_shard[edges[at]:edges[at + 1]], spots[spot_edges[at]:spot_edges[at + 1]]
                    yield sent(row["block"], number, key[mine], offset[mine], size[mine], least[mine],
                               [texts[i] for i in mine.tolist()], place[seen[here]] - edges[at], firsts[here], other[here])

    return one


def _tied(words, group):
    """Numbers that are equal where ``group`` and all columns of ``words`` are, by sorting column after column.

    A column orders only rows that all columns before left tied.
    """
    import numpy as np

    order = np.argsort(group, kind="stable")
    n = len(order)
    if not n:
        return group
    new = np.r_[True, group[order][1:] != group[order][:-1]]
    for column in range(words.shape[1]):
        rank = np.cumsum(new)
        crowd = np.bincount(rank)[rank] > 1
        spots = np.flatnonzero(crowd)
        if not len(spots):
            break
        rows = order[spots]
        digit = words[rows, column]
        within = np.lexsort((digit, rank[spots]))
        order[spots] = rows[within]
        digit, own = digit[within], rank[spots]
        new[spots[1:]] |= (digit[1:] != digit[:-1]) & (own[1:] == own[:-1])
    out = np.empty(n, dtype=np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def _columns(flat, starts, lengths, width: int):
    """Byte strings as rows of big-endian 8-byte numbers, zero-filled."""
    import numpy as np

    out = np.empty((len(starts), -(-width // 8)), dtype=np.uint64)
    for at in range(0, len(starts), 1 << 16):  # the places take eight times the bytes
        some = slice(at, at + (1 << 16))
        places = starts[some, None] + np.arange(width)[None, :]
        inside = np.arange(width)[None, :] < lengths[some, None]
        rows = np.where(inside, flat[np.minimum(places, len(flat) - 1)], 0).astype(np.uint8)
        rows = np.hstack([rows, np.zeros((len(rows), -width % 8), np.uint8)])
        out[some] = np.ascontiguousarray(rows).view(">u8")
    return out


#: Strings of a bucket sorted in one go, or one anchor; strings of a part of a hot anchor.
_SORT_ROWS = 150_000


def _judged(rows: list[dict]) -> Iterator[dict]:
    """For every place that a block sent: which of its strings also start in a smaller document."""
    import numpy as np

    def join(name, kind):
        return np.frombuffer(b"".join(r[name] for r in rows), kind)

    keys, offsets = join("keys", np.uint64), join("offsets", np.uint8).astype(np.int64)
    counts = join("counts", np.uint8).astype(np.int64)
    least = np.frombuffer(b"".join(expand(r["least"]) for r in rows), np.int64)
    flat = np.frombuffer(b"".join(expand(r["texts"]) for r in rows), np.uint8)
    sizes = counts + MIN_BYTES - 1
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    masks = np.zeros(len(keys), dtype=np.uint32)
    order = np.argsort(keys, kind="stable")
    edges = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]])
    load = np.concatenate([[0], np.cumsum(counts[order])])
    edges = np.r_[edges, len(order)]
    at = 0
    while at < len(edges) - 1:  # whole anchors, as many as fit
        upto = max(at + 1, int(np.searchsorted(load[edges], load[edges[at]] + _SORT_ROWS, side="right")) - 1)
        some = order[edges[at]:edges[upto]]
        at = upto
        # equal surroundings first: most anchors have one
        head = np.unique(np.stack([keys[some], (offsets[some] << 8 | counts[some]).astype(np.uint64)], axis=1),
                         axis=0, return_inverse=True)[1].ravel()
        same = _tied(_columns(flat, starts[some], sizes[some], SPAN + MIN_BYTES - 1), head)
        smallest = np.full(same.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(smallest, same, least[some])
        sample = np.empty(len(smallest), dtype=np.int64)
        sample[same] = np.arange(len(some))
        reps = some[sample]
        _, anchor, alike = np.unique(keys[reps], return_inverse=True, return_counts=True)
        lonely = alike[anchor] == 1
        won = np.zeros(0, np.int64)
        base = np.full(len(reps), -1)
        several = np.flatnonzero(~lonely)
        if len(several):
            n = counts[reps[several]]
            base[several] = np.concatenate([[0], np.cumsum(n)[:-1]])
            which = np.repeat(several, n)
            step = np.arange(n.sum()) - np.repeat(base[several], n)
            group = anchor[which] * 256 + (offsets[reps[which]] - step) + 128
            equal = _tied(_columns(flat, starts[reps[which]] + step, np.full(len(step), MIN_BYTES), MIN_BYTES), group)
            least_of = np.full(equal.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(least_of, equal, smallest[which])
            won = least_of[equal]
        full = ((np.uint64(1) << counts[some].astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
        plain = base[same] < 0
        masks[some[plain]] = np.where(smallest[same[plain]] < least[some[plain]], full[plain], 0)
        rest = np.flatnonzero(~plain)
        if len(rest):
            n = counts[some[rest]]
            which = np.repeat(rest, n)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            bit = (won[base[same[which]] + step] < least[some[which]]).astype(np.uint32) << step.astype(np.uint32)
            masks[some[rest]] = np.bitwise_or.reduceat(bit, np.cumsum(n) - n)
    begin = 0
    for r in rows:
        own = len(r["keys"]) // 8
        mask, count = masks[begin:begin + own], counts[begin:begin + own]
        begin += own
        owner = np.cumsum(np.frombuffer(expand(r["owner"]), np.int32))
        others = np.frombuffer(expand(r["others"]), np.uint8).astype(bool)
        whole = ((np.uint64(1) << count.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
        said = np.where(others, whole[owner], mask[owner])
        hit = np.flatnonzero(said)
        if len(hit):
            yield {"block": r["block"], "places": np.frombuffer(r["places"], np.uint32)[hit].tobytes(),
                   "masks": said[hit].tobytes()}


def _removed(size: int, rows: list[dict]):
    """Which bytes of a block lie in a removed string."""
    import numpy as np

    starts = np.zeros(size + 1, dtype=np.int32)
    for r in rows:
        places = np.frombuffer(r["places"], np.uint32).astype(np.int64)
        masks = np.frombuffer(r["masks"], np.uint32)
        for bit in range(SPAN):
            starts[places[(masks >> np.uint32(bit) & np.uint32(1)).astype(bool)] + bit] = 1
    run = np.cumsum(starts[:size], dtype=np.int32)
    before = np.zeros(size, dtype=np.int32)
    before[MIN_BYTES:] = run[:-MIN_BYTES] if size > MIN_BYTES else 0
    return run > before


def _sent(blocks: DataFrame, cuts) -> DataFrame:
    """What goes to the buckets, and to the parts of hot anchors."""
    shared = per_shard(_dealt(blocks, cuts), _shared(HOT_STRINGS, _SORT_ROWS), _SHARED)
    return together(blocks, shared, "block", _around(cuts), _AROUND)


def _applied(docs: DataFrame, key: str, text: str, row_of, schema: str) -> DataFrame:
    import numpy as np

    blocks = pack(docs, key, text, "suffix-blocks", 4 << 20)
    cuts = _splitters(blocks)
    answers = per_shard(_sent(blocks, cuts), _judged, "block long, places binary, masks binary")

    def one(own: list[dict], got: list[dict]) -> Iterator[dict]:
        for row in own:
            block = Block(row)
            gone = _removed(len(block.data), got)
            data = np.frombuffer(block.data, np.uint8)
            for name, a, b in zip(block.keys, block.starts.tolist(), block.ends.tolist()):
                out = gone[a:b]
                spans = int(out[:1].sum()) + int((out[1:] & ~out[:-1]).sum())
                yield row_of(name, b - a, int(out.sum()), spans, data[a:b][~out].tobytes())

    return together(blocks, answers, "block", one, schema)


def dedup_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256), a row per row."""

    def row(name, size, removed, spans, kept):
        return {"_key": name, "n_bytes": size, "n_removed": removed, "n_spans": spans,
                "kept_sha256": hashlib.sha256(kept).hexdigest()}

    return _applied(docs, key, text, row, "_key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
                    ).withColumnRenamed("_key", key)


def dedup_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kept binary): the texts' bytes without what smaller documents hold."""

    def row(name, size, removed, spans, kept):
        return {"_key": name, "kept": kept}

    return _applied(docs, key, text, row, "_key long, kept binary").withColumnRenamed("_key", key)
