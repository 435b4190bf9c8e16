"""Near-duplicates by SimHash, found by balls that meet half way.

Two fingerprints at distance 2 meet in a third at distance 1 from both. Radius
3 is odd: a ball of radius 2 per fingerprint would have 2,081 members. Instead
the 64 bits are cut into three groups; if three bits differ, leaving out one
group that holds a differing bit leaves at most two, and balls of radius 1 meet.
So each distinct fingerprint emits, for each left-out group, its rest and all
rests one bit away: 131 variants. They are shuffled, fingerprints that share a
variant are verified on all bits, and what is linked inside a bucket leaves as
a star, never as all pairs.

Defined results: null, empty and blank texts have fingerprint zero and are linked
like any other; texts are read whole; ties of bits count as 0; repeated rows
are equal fingerprints and so one group; a null key takes part and never names a
group, unless all its members are null; an empty table gives an empty table;
columns besides the two named ones never matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.components import components
from folioflow.llm.rows import per_text
from folioflow.operators.skew import heavy_keys, join_unique
from folioflow.session import materialize

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Bits of the three groups.
GROUPS = ((0, 21), (21, 42), (42, 64))
#: Variants that one task verifies.
TASK_ROWS = 1_000_000


def fingerprint_one(text: str, size: int = SHINGLE) -> int:
    """The 64-bit fingerprint as a signed number."""
    import numpy as np
    import xxhash

    words = text.encode("utf-8").lower().split()  # bytes: only A-Z change, only \x20 and \x09-\x0D part
    if not words:
        return 0
    if len(words) < size:
        grams = [b" ".join(words)]
    elif size == 3:
        grams = [a + b" " + b + b" " + c for a, b, c in zip(words, words[1:], words[2:])]
    else:
        grams = [b" ".join(words[i:i + size]) for i in range(len(words) - size + 1)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, SEED) for g in grams], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at:at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (ones * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """(key, fp long): a row per row; no shuffle."""
    return per_text(df, key, text, lambda: lambda t: (fingerprint_one(t, size),), ["fp"], [pa.int64()], "fp long")


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    masks, flips = [], []
    for low, high in GROUPS:
        out = sum(1 << b for b in range(low, high))
        masks.append(~out & (2**64 - 1))
        flips.append([0, *(1 << b for b in range(64) if not low <= b < high)])
    for batch in batches:
        for at in range(0, batch.num_rows, 8192):
            fp = batch.column("fp").slice(at, 8192).to_numpy(zero_copy_only=False).view(np.uint64)
            for mask, bits in zip(masks, flips):
                rest = (fp & np.uint64(mask))[:, None] ^ np.array(bits, dtype=np.uint64)[None, :]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rest.ravel().view(np.int64)), pa.array(np.repeat(fp.view(np.int64), len(bits)))],
                    ["variant", "fp"])


def _verified(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        keys, fps = [], []
        for batch in batches:
            keys.append(batch.column("variant").to_numpy(zero_copy_only=False))
            fps.append(batch.column("fp").to_numpy(zero_copy_only=False))
        if not keys:
            return
        key, fp = np.concatenate(keys), np.concatenate(fps).view(np.uint64)
        keys.clear(), fps.clear()
        order = np.argsort(key)
        key, fp = key[order], fp[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        two = starts[sizes == 2]
        near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
        links = [np.stack([fp[near], fp[near + 1]], axis=1)]
        for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            rest = np.unique(fp[start:start + size])
            while len(rest) > 1:  # a star for each group that hangs together inside the bucket
                centre, rest, edge = rest[0], rest[1:], [rest[0]]
                while edge and len(rest):
                    near_it = np.bitwise_count(rest ^ edge.pop()) <= radius
                    got = rest[near_it]
                    if len(got):
                        rest = rest[~near_it]
                        edge.extend(got)
                        links.append(np.stack([np.full(len(got), centre), got], axis=1))
        found = np.unique(np.concatenate(links), axis=0).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return run


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """distinct (fp long) -> (a, b): links that connect all fingerprints at most ``radius`` bits apart."""
    if not 0 < radius <= RADIUS:
        raise ValueError(f"radius is 1 to {RADIUS}")
    rows = distinct.count() * (64 * 3 - 64 + 3)
    parts = max(1, -(-rows // TASK_ROWS))
    dealt = distinct.mapInArrow(_variants, "variant long, fp long").repartition(parts, "variant")
    return dealt.mapInArrow(_verified(radius), "a long, b long").distinct()


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(key, fingerprint, component_id): component_id is the smallest key reachable over links."""
    prints = materialize(fingerprints(df, key, text), "fingerprints")
    classes = materialize(prints.groupBy("fp").agg(F.min(key).alias("least"), F.count("*").alias("n")), "classes")
    roots = components(links(classes.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = materialize(classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    sizes = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    sizes = materialize(sizes, "components")
    named = join_unique(rooted.select("fp", "root", "n"), sizes.select("root", "component_id"), "root",
                        heavy_keys(sizes, "root"), ["fp"])
    named = materialize(named.select("fp", "component_id", "n"), "named-classes")
    out = join_unique(prints, named.select("fp", "component_id"), "fp", heavy_keys(named, "fp"), [key])
    return out.select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """The row with the smallest key of every group, all columns as they were.

    Keys have to tell the rows apart; rows without a key stay.
    """
    kept = near_duplicates(df, key, text, radius).where(F.col(key) == F.col("component_id")).select(
        F.col(key).alias("_kept")).distinct()
    # the kept keys grow with the rows, so they are never broadcast, at no size
    kept = materialize(kept, "kept").hint("shuffle_hash")
    stay = df.join(kept, df[key] == kept["_kept"], "left_semi")
    return stay.unionByName(df.where(df[key].isNull()))
