"""Hard-negative mining with full exact scores by the method of the four Russians.

Components become floor(256 * x). A candidate is stored as bit planes: for every
group of eight dimensions and every bit of the numbers (two's complement) one byte.
For each anchor and group a table holds the sums of all 256 subsets of the anchor's
eight components. The inner product is then, plane by plane from the highest,
"shift what there is, add the looked-up sums of all groups"; the highest plane counts
negatively. Tables of a block of anchors lie side by side, so one lookup serves the
whole block.

Anchors are a stated query set: they meet all rows in blocks. Rows and anchors are
dealt to a grid by a hash of their id; a task gets one cell, ``CHUNK`` candidates
and ``ANCHORS`` anchors at most (about), whatever labels they have, so a label with
a third of the rows is no hot spot. The first pass scores rows of the anchor's own
label and keeps the best as positives; their scores are the bounds within which the
second pass looks among all other labels.

Defined results: rows without id or label, with a null vector or a null, NaN or
infinite component take no part; shorter vectors count as filled up with zeros; of
several rows with one id the smallest (label, vector) counts; scores beyond
+-(2^63 - 1) take that value, such products are computed over Python integers; a
component that overflows a double when scaled counts as infinite; ties go to the smaller id; a negative positive score admits nothing; an
empty table gives an empty table; columns besides the named ones never matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.quantize import finite_vectors, matrix_of
from folioflow.session import materialize

SCALE = 256
GROUP = 8
#: Candidates and anchors of one cell, about; anchors whose tables are held at once.
CHUNK, ANCHORS, BLOCK = 16384, 32768, 128
POSITIVES, NEGATIVES = 5, 3
#: Percent of the positive score between which a negative's lies.
LOW, HIGH = 50, 95
_LOW, _HIGH = 1 - 2**63, 2**63 - 1


def whole(values, planes: int):
    """floor(256 * x): int64, or Python integers where more than 63 planes are needed."""
    import numpy as np

    out = np.floor(values * SCALE)
    return out.astype(np.int64) if planes <= 63 else np.array([[int(x) for x in r] for r in out], dtype=object).reshape(out.shape)


def planes_for(largest: float) -> int:
    """Bits that hold every number up to this size, sign included."""
    return int(largest).bit_length() + 1


def bit_planes(numbers, planes: int):
    """uint8 [planes, groups, rows]: bit b of eight neighbouring components in one byte, lowest plane first."""
    import numpy as np

    rows, size = numbers.shape
    groups = -(-size // GROUP)
    out = np.zeros((planes, groups, rows), dtype=np.uint8)
    for b in range(planes):
        bits = ((numbers >> b) & 1).astype(np.uint8)
        out[b] = np.packbits(np.pad(bits, ((0, 0), (0, groups * GROUP - size))).reshape(rows, groups, GROUP),
                             axis=2, bitorder="little")[:, :, 0].T
    return out


def subset_sums(anchors, kind):
    """[groups, 256, anchors]: for each byte the sum of the anchor's components whose bits are set."""
    import numpy as np

    count, size = anchors.shape
    groups = -(-size // GROUP)
    padded = np.zeros((count, groups * GROUP), dtype=kind)
    padded[:, :size] = anchors
    out = np.zeros((groups, 1 << GROUP, count), dtype=kind)
    for j in range(GROUP):  # the upper half of each doubling adds component j
        out[:, 1 << j:2 << j] = out[:, :1 << j] + padded[:, j::GROUP].T[:, None, :]
    return out


def scores(planes, tables):
    """[rows, anchors] exact inner products, by looking up every byte and shifting from the highest plane down."""
    import numpy as np

    bits, groups, rows = planes.shape
    total = np.zeros((rows, tables.shape[2]), dtype=tables.dtype)
    found = np.empty_like(total)
    for b in range(bits - 1, -1, -1):
        total *= 2
        for g in range(groups):
            np.take(tables[g], planes[b, g], axis=0, out=found, mode="clip")
            if b == bits - 1:
                total -= found
            else:
                total += found
    return total


def _kind(size: int, planes: int, others: int):
    """The narrowest type that holds every intermediate sum."""
    import numpy as np

    reach = max(GROUP, size) * 2 ** (others - 1) * (2 ** (planes - 1) + 1)
    return np.int32 if reach < 2**31 else np.int64 if reach < 2**63 else object


class Held:
    """Candidates of a cell: usual ones and, apart, those whose numbers are far larger."""

    def __init__(self, table: pa.Table, size: int):
        import numpy as np

        self.ids, self.labels = table["id"].to_numpy(), table["label"].to_numpy()
        self.size, self.groups = size, -(-size // GROUP)
        self.bits = table["bits"].to_numpy()
        self.classes = {}
        packed = table["planes"].to_pylist()
        for bits in np.unique(self.bits):
            at = np.flatnonzero(self.bits == bits)
            own = np.frombuffer(b"".join(packed[i] for i in at), np.uint8).reshape(len(at), int(bits), self.groups)
            self.classes[int(bits)] = at, own

    def scored(self, tables_of, pick):
        """Scores of the candidates in ``pick`` with the anchors whose tables ``tables_of(kind)`` gives, as int64."""
        import numpy as np

        out = None
        inside = np.zeros(len(self.ids), dtype=bool)
        inside[pick] = True
        place = np.cumsum(inside) - 1
        for bits, (at, own) in self.classes.items():
            mine = inside[at]
            if not mine.any():
                continue
            planes = np.ascontiguousarray(own[mine].transpose(1, 2, 0))
            got = scores(planes, tables_of(bits))
            if got.dtype == object:
                got = np.clip(got, _LOW, _HIGH).astype(np.int64)
            if out is None:
                out = np.zeros((len(pick), got.shape[1]), dtype=np.int64)
            out[place[at[mine]]] = got
        return np.zeros((0, 0), np.int64) if out is None else out


def _blocks(anchors: pa.Table, size: int) -> Iterator:
    """(ids, labels, rows of numbers, tables by planes of the candidate) for blocks of anchors of like size."""
    import numpy as np

    order = np.lexsort((anchors["id"].to_numpy(), anchors["label"].to_numpy(), anchors["bits"].to_numpy()))
    table = anchors.take(pa.array(order))
    bits, labels = table["bits"].to_numpy(), table["label"].to_numpy()
    cut = np.flatnonzero(np.r_[True, bits[1:] != bits[:-1]]) if len(bits) else np.zeros(0, int)
    for start, stop in zip(cut, [*cut[1:], len(bits)]):
        for at in range(int(start), int(stop), BLOCK):
            end = min(int(stop), at + BLOCK)
            part = table.slice(at, end - at)
            own = int(bits[at])
            numbers = whole(matrix_of(part["v"].combine_chunks(), size), own)
            known: dict = {}

            def tables(candidate_bits: int, numbers=numbers, own=own, known=known):
                kind = _kind(size, candidate_bits, own)
                if kind not in known:
                    known[kind] = subset_sums(numbers, kind)
                return known[kind]

            yield part, part["id"].to_numpy(), labels[at:end], tables


def _best(ids, score, most: int):
    """Positions of the ``most`` highest scores, ties to smaller ids."""
    import numpy as np

    if len(score) > 4 * most:
        limit = np.partition(score, len(score) - most)[len(score) - most]
        some = np.flatnonzero(score >= limit)
    else:
        some = np.arange(len(score))
    return some[np.lexsort((ids[some], -score[some]))][:most]


def _positives(held: Held, anchors: pa.Table, most: int) -> Iterator[tuple]:
    """Best rows of each anchor's own label."""
    import numpy as np

    by_label = np.argsort(held.labels, kind="stable")
    ordered = held.labels[by_label]
    for _, ids, labels, tables in _blocks(anchors, held.size):
        for label in np.unique(labels):
            pick = by_label[np.searchsorted(ordered, label):np.searchsorted(ordered, label, "right")]
            if not len(pick):
                continue
            mine = np.flatnonzero(labels == label)
            got = held.scored(lambda b, m=mine: np.ascontiguousarray(tables(b)[:, :, m]), pick)
            own = held.ids[pick]
            for column, anchor in enumerate(ids[mine]):
                other = np.flatnonzero(own != anchor)
                best = other[_best(own[other], got[other, column], most)]
                for i in best:
                    yield int(anchor), int(own[i]), int(got[i, column])


def _negatives(held: Held, anchors: pa.Table, most: int, low: int, high: int) -> Iterator[tuple]:
    """For each anchor and positive the best rows of other labels within the bounds."""
    import numpy as np

    everyone = np.arange(len(held.ids))
    for part, ids, labels, tables in _blocks(anchors, held.size):
        got = held.scored(tables, everyone)
        for column, (anchor, label, found) in enumerate(zip(ids, labels, part["found"].to_pylist())):
            bounds = [(p["positive_id"], p["score"], max(_LOW, -(-low * p["score"] // 100)), min(_HIGH, high * p["score"] // 100))
                      for p in found]
            bounds = [b for b in bounds if b[2] <= b[3]]
            if not bounds:
                continue
            own = got[:, column]
            some = np.flatnonzero((own >= min(b[2] for b in bounds)) & (own <= max(b[3] for b in bounds)) & (held.labels != label))
            some = some[np.lexsort((held.ids[some], -own[some]))]
            falling = own[some]
            rising = falling[::-1]
            for positive, score, least, most_score in bounds:
                start = len(falling) - int(np.searchsorted(rising, most_score, "right"))
                for i in some[start:start + most]:
                    if own[i] < least:
                        break
                    yield int(anchor), positive, int(held.ids[i]), score, int(own[i])


def _deal(held: DataFrame, anchors: DataFrame, rows: int, asked: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with the numbers of their cells in the grid; both are repeated along one side of it."""
    across, down = max(1, -(-rows // CHUNK)), max(1, -(-asked // ANCHORS))

    def spread(n: int, seed: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    return (held.select("*", spread(across, 1).alias("across"), every(down).alias("down")),
            anchors.select("*", spread(down, 2).alias("down"), every(across).alias("across")))


def _per_cell(held: DataFrame, anchors: DataFrame, size: int, work, schema: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def one(a: pa.Table, b: pa.Table) -> pa.Table:
        found = list(work(Held(a, size), b)) if a.num_rows and b.num_rows else []
        columns = list(zip(*found)) if found else [[] for _ in arrow]
        return pa.table([pa.array(list(c), f.type) for c, f in zip(columns, arrow)], schema=arrow)

    keys = ["across", "down"]
    return held.groupBy(*keys).cogroup(anchors.groupBy(*keys)).applyInArrow(one, schema)


def mine(rows: DataFrame, is_anchor: Column, label: Column | None = None, key: str = "vec_id", vector: str = "embedding",
         label_name: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW,
         high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` and ``label`` (a whole number; by default the column of that name) are
    expressions over ``rows``. ``low`` and ``high`` bound a negative's score in percent
    of the positive's.
    """
    source = rows.select(rows[key].alias("_id"), rows[vector].alias("_v"), F.coalesce(is_anchor, F.lit(False)).alias("_asks"),
                         (rows[label_name] if label is None else label).cast("long").alias("_label"))
    known = finite_vectors(source, "_id", "_v", SCALE, "_asks", "_label").where("key IS NOT NULL AND _label IS NOT NULL")
    one = known.groupBy(F.col("key").cast("long").alias("id")).agg(
        F.min(F.struct("_label", "v")).alias("row"), F.max("_asks").alias("asks"))
    usable = materialize(one.select("id", F.col("row._label").alias("label"), "row.v", "asks"), "labelled")
    facts = usable.agg(F.count("*"), F.max(F.size("v")), F.count(F.when(F.col("asks"), 1))).first()
    count, size, asked = facts[0], max(1, facts[1] or 1), facts[2]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            values = matrix_of(batch.column("v"), size)
            largest = np.maximum(np.abs(np.floor(values * SCALE)).max(axis=1, initial=0), 1)
            needed = np.array([planes_for(x) for x in largest], dtype=np.int32)
            needed = -(-needed // 4) * 4  # a few sizes only, so that rows of one size go together
            packed = [b""] * len(values)
            for bits in np.unique(needed):
                at = np.flatnonzero(needed == bits)
                cut = bit_planes(whole(values[at], int(bits)), int(bits)).transpose(2, 0, 1)
                for i, planes in zip(at, np.ascontiguousarray(cut)):
                    packed[i] = planes.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(needed), pa.array(packed, pa.binary()), batch.column("asks"),
                 pa.array([v if a else None for v, a in zip(batch.column("v").to_pylist(), batch.column("asks").to_pylist())],
                          pa.list_(pa.float64()))], ["id", "label", "bits", "planes", "asks", "v"])

    stored = materialize(usable.mapInArrow(
        pack, "id long, label long, bits int, planes binary, asks boolean, v array<double>"), "bit-planes")
    held = stored.select("id", "label", "bits", "planes")
    anchors = stored.where("asks").select("id", "label", "bits", "v")
    near = _per_cell(*_deal(held, anchors, count, asked), size, lambda h, a: _positives(h, a, positives),
                     "anchor_id long, positive_id long, score long")
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
    chosen = near.withColumn("at", F.row_number().over(best)).where(F.col("at") <= positives)
    found = chosen.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "score")).alias("found"))
    asking = materialize(anchors.join(found, anchors["id"] == found["anchor_id"]).select("id", "label", "bits", "v", "found"), "anchors")
    hard = _per_cell(*_deal(held, asking, count, asked), size, lambda h, a: _negatives(h, a, negatives, low, high),
                     "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
