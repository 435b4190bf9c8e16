"""Exact top-k search by inner product over a pivot-distance index.

Components are turned into whole numbers, so inner products are exact. One more
component makes all candidates equally long (the longest length, which the index
keeps); then a larger inner product is a smaller distance. Every vector goes to
its nearest pivot and is keyed by its distance from it; rings cut the distances of
a pivot. Pivots and ring borders come from a bounded sample of the rows; the index
holds every row.

A query first expands the annuli of the ring it falls into, nearest distance
first, until the triangle inequality says that the rest is too far. Its k-th
distance so far then selects the rings that can still hold something better; only
these are searched, again annulus by annulus. Nothing else is approximate, so the
result is the brute-force one.

Rings that hold many vectors are cut into chunks, and the queries of a ring travel
in parts of ``QUERY_PART``; a task meets one chunk and one part.

Vectors with a component beyond ``HUGE`` (or more than ``LONG`` components) stay out of
the index, so that squared lengths and products inside it fit a long. What they have
part in, as query or as candidate, is computed over Python integers in blocks.

Defined results: vectors that are null, or hold a null, NaN or infinite component (a
component that overflows a double when scaled counts as infinite), and rows without
an id take no part; scores beyond +-(2^63 - 1) take that value; shorter vectors count as filled up with
zeros; of several rows with one id the smallest vector counts; ties go to the
smaller id; a query with fewer than k others gets all of them; an empty table
gives an empty table; columns besides the named ones never matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.session import materialize

SCALE = 256
PIVOTS = 32
RINGS = 8
#: Rows that pivots and ring borders are taken from, about.
SAMPLE = 4096
CHUNK = 8192
QUERY_PART = 16384
#: Vectors of one step outwards.
STEP = 512


#: Numbers and lengths up to which products fit: LONG * HUGE ** 2 = 2 ** 62.
HUGE, LONG = 1 << 24, 1 << 14
_TOP = 2**63 - 1


def whole_numbers(vector: Column) -> Column:
    """floor(256 * x) of every component, as double; null if one is missing or not finite."""
    scaled = F.transform(vector, lambda x: x.cast("double") * float(SCALE))
    good = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # doubles beyond 2^53 are whole
    whole = F.transform(scaled, lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x))
    return F.when(vector.isNotNull() & good, whole)


class Index:
    """What tasks know of the index: pivots, ring borders, the longest length, chunks of each ring."""

    def __init__(self, size: int, longest: int, largest: int, sample, k: int):
        import numpy as np

        self.size, self.k, self.longest = size, k, longest
        self.kind = np.float64 if size * max(1, largest) ** 2 < 2**53 else np.int64  # both exact
        self.slack = 1e-6 * (1 + 2.0 * longest**0.5)  # more than rounding can add to a distance
        rows = self.lifted(sample)
        far = np.full(len(rows), np.inf)
        chosen, at = [], 0
        for _ in range(min(PIVOTS, len(rows))):  # farthest first
            chosen.append(rows[at])
            far = np.minimum(far, ((rows - rows[at]) ** 2).sum(axis=1))
            at = int(far.argmax())
        self.pivots = np.array(chosen).reshape(-1, size + 1)
        pivot, dist = self.place(rows)
        self.borders = np.array([
            np.quantile(own, np.arange(1, RINGS) / RINGS) if len(own := dist[pivot == p]) else np.zeros(RINGS - 1)
            for p in range(len(self.pivots))])
        self.chunks = np.ones(len(self.pivots) * RINGS, dtype=np.int64)

    def matrix(self, vectors):
        """Rows of one length."""
        import numpy as np

        out = np.zeros((len(vectors), self.size), dtype=self.kind)
        for i, v in enumerate(vectors):
            out[i, :len(v)] = v
        return out

    def lifted(self, rows):
        import numpy as np

        real = rows.astype(np.float64)
        return np.hstack([real, np.sqrt(np.maximum(0.0, self.longest - (real * real).sum(axis=1)))[:, None]])

    def distances(self, points):
        import numpy as np

        square = (points**2).sum(axis=1)[:, None] + (self.pivots**2).sum(axis=1)[None, :] - 2 * points @ self.pivots.T
        return np.sqrt(np.maximum(0.0, square))

    def place(self, points):
        import numpy as np

        every = self.distances(points)
        pivot = every.argmin(axis=1)
        return pivot, every[np.arange(len(points)), pivot]

    def rings(self, pivot, dist):
        import numpy as np

        return pivot * RINGS + (dist[:, None] > self.borders[pivot]).sum(axis=1) if len(pivot) else np.zeros(0, np.int64)

    def floors(self, points):
        """For each query and ring the least distance that one of its vectors can have, and which ring is its own."""
        import numpy as np

        every = self.distances(points)
        low = np.hstack([np.zeros((len(self.borders), 1)), self.borders])
        high = np.hstack([self.borders, np.full((len(self.borders), 1), np.inf)])
        d = every[:, :, None]
        floor = np.maximum(0.0, np.maximum(low[None] - d, d - high[None])).reshape(len(points), -1)
        return every, floor


def _encoded(values, kind) -> bytes:
    import numpy as np

    return np.ascontiguousarray(values, dtype=kind).tobytes()


_ENTRY = "cell int, chunk int, dist double, vec_id long, v binary"


def build(vectors: DataFrame, k: int) -> tuple[DataFrame, Index] | None:
    """vectors (vec_id, v array<long>) -> the written index, and what describes it."""
    import numpy as np

    facts = vectors.select(
        F.size("v").alias("n"), F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x).alias("square"),
        F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0)).alias("largest")).agg(
        F.count("*"), F.max("n"), F.max("square"), F.max("largest")).first()
    if not facts[0]:
        return None
    share = F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, SAMPLE / facts[0])) + 1
    rows = vectors.where(share).select("vec_id", "v").collect() or vectors.select("vec_id", "v").limit(1).collect()
    rows.sort(key=lambda r: r.vec_id)
    sample = np.zeros((len(rows), facts[1]), dtype=np.int64)
    for i, r in enumerate(rows):
        sample[i, :len(r.v)] = r.v
    index = Index(facts[1], facts[2], facts[3], sample, k)
    shipped = vectors.sparkSession.sparkContext.broadcast(index)  # a few hundred numbers per pivot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        for batch in batches:
            matrix = known.matrix(batch.column("v").to_pylist())
            pivot, dist = known.place(known.lifted(matrix))
            yield pa.RecordBatch.from_arrays(
                [pa.array(known.rings(pivot, dist).astype(np.int32)), pa.array(dist), batch.column("vec_id"),
                 pa.array([_encoded(m, known.kind) for m in matrix], pa.binary())], ["cell", "dist", "vec_id", "v"])

    placed = materialize(vectors.select("vec_id", "v").mapInArrow(
        run, "cell int, dist double, vec_id long, v binary"), "pivot-index")
    for r in placed.groupBy("cell").count().collect():  # at most PIVOTS * RINGS
        index.chunks[r["cell"]] = -(-r["count"] // CHUNK)
    return placed, index


def _asked(queries: DataFrame, index: Index, parts: int, first: bool) -> DataFrame:
    """Queries (vec_id, v, kth) dealt to the chunks of their own ring, or of all others that can matter."""
    import numpy as np

    shipped = queries.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        for batch in batches:
            matrix = known.matrix(batch.column("v").to_pylist())
            points = np.hstack([matrix.astype(np.float64), np.zeros((len(matrix), 1))])
            every, floor = known.floors(points)
            own = floor.argmin(axis=1)
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            kth = batch.column("kth").to_numpy(zero_copy_only=False)
            wanted = np.zeros(floor.shape, dtype=bool)
            if first:
                wanted[np.arange(len(own)), own] = True
            else:
                wanted = floor <= kth[:, None] + known.slack
                wanted[np.arange(len(own)), own] = False
            out = []
            part = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            for p in range(parts):
                mine = part % np.uint64(parts) == p
                for cell in np.flatnonzero(wanted[mine].any(axis=0)).tolist():
                    at = np.flatnonzero(wanted[:, cell] & mine)
                    for chunk in range(int(known.chunks[cell])):
                        out.append((cell, chunk, p, _encoded(ids[at], np.int64), _encoded(matrix[at], known.kind),
                                    _encoded(every[at, cell // RINGS], np.float64), _encoded(kth[at], np.float64)))
            if out:
                kinds = [pa.int32()] * 3 + [pa.binary()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)], _QUESTION_NAMES)

    return queries.mapInArrow(run, _QUESTION)


_QUESTION_NAMES = ["cell", "chunk", "part", "ids", "vectors", "dists", "kths"]
_QUESTION = "cell int, chunk int, part int, ids binary, vectors binary, dists binary, kths binary"


def _search(placed: DataFrame, asked: DataFrame, index: Index, parts: int) -> DataFrame:
    """(query_id, vec_id, score): of each chunk the best that a query may need."""
    import numpy as np

    shipped = placed.sparkSession.sparkContext.broadcast(index)
    chunks = F.create_map(*[x for c, n in enumerate(index.chunks.tolist()) for x in (F.lit(c), F.lit(n))])
    entries = placed.select(
        "cell", F.pmod(F.xxhash64("vec_id"), chunks[F.col("cell")]).cast("int").alias("chunk"),
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "dist", "vec_id", "v")
    found = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def one(held: pa.Table, questions: pa.Table) -> pa.Table:
        known, out = shipped.value, []
        if held.num_rows and questions.num_rows:
            dist = held["dist"].to_numpy()
            order = np.argsort(dist)
            dist, ids = dist[order], held["vec_id"].to_numpy()[order]
            vectors = np.frombuffer(b"".join(held["v"].to_pylist()), known.kind).reshape(-1, known.size)[order]
            for row in questions.to_pylist():
                asked_ids = np.frombuffer(row["ids"], np.int64)
                points = np.frombuffer(row["vectors"], known.kind).reshape(-1, known.size)
                for q, point, away, kth in zip(asked_ids, points, np.frombuffer(row["dists"], np.float64),
                                               np.frombuffer(row["kths"], np.float64)):
                    best = _expand(known, dist, ids, vectors, q, point, away, kth)
                    out.append((np.full(len(best[0]), q), *best))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table([pa.array(c.astype(np.int64)) for c in columns], schema=found)

    keys = ["cell", "chunk", "part"]
    return entries.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(
        one, "query_id long, vec_id long, score long")


def _expand(known: Index, dist, ids, vectors, query, point, away: float, kth: float):
    """Annuli of a chunk from the query's own distance outwards, until the rest is farther than the k-th best."""
    import numpy as np

    k, length = known.k, float((point.astype(np.float64) ** 2).sum()) + known.longest
    right = left = int(np.searchsorted(dist, away))
    best_ids, best = np.zeros(0, np.int64), np.zeros(0, vectors.dtype)
    while True:
        reach = kth + known.slack
        go_left = left > 0 and away - dist[left - 1] <= reach
        go_right = right < len(dist) and dist[right] - away <= reach
        if not (go_left or go_right):
            return best_ids, best
        low = max(0, left - STEP) if go_left else left
        high = min(len(dist), right + STEP) if go_right else right
        new = np.r_[low:left, right:high]
        left, right = low, high
        new = new[ids[new] != query]
        best = np.concatenate([best, vectors[new] @ point])
        best_ids = np.concatenate([best_ids, ids[new]])
        top = np.lexsort((best_ids, -best))[:k]
        best_ids, best = best_ids[top], best[top]
        if len(best) == k:
            kth = min(kth, max(0.0, length - 2.0 * float(best[-1])) ** 0.5)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query; a query has at most k rows from each chunk."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _exact(queries: DataFrame, others: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) over Python integers: of each block of ``others`` (vec_id, w) the k best of each query."""
    across, down = (max(1, -(-df.count() // CHUNK)) for df in (others, queries))

    def spread(n: int) -> Column:
        return F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def one(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = []
        rows = [(i, [int(x) for x in w]) for i, w in zip(held["vec_id"].to_pylist(), held["w"].to_pylist())]
        for q, w in zip(asked["vec_id"].to_pylist(), asked["w"].to_pylist()):
            mine = [int(x) for x in w]
            got = [(max(-_TOP, min(_TOP, sum(a * b for a, b in zip(mine, v)))), i) for i, v in rows if i != q]
            out += [(q, i, s) for s, i in sorted(got, key=lambda g: (-g[0], g[1]))[:k]]
        columns = list(zip(*out)) if out else [[], [], []]
        return pa.table({n: pa.array(list(c), pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns)})

    keys = ["across", "down"]
    asked = queries.select("vec_id", "w", spread(down).alias("down"), every(across).alias("across"))
    held = others.select("vec_id", "w", spread(across).alias("across"), every(down).alias("down"))
    return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(one, "query_id long, vec_id long, score long")


def top_k(rows: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for rows with ``is_query`` the k other rows of largest inner product."""
    usable = rows.select(rows[key].cast("long").alias("vec_id"), whole_numbers(rows[vector]).alias("w"),
                         F.coalesce(is_query, F.lit(False)).alias("asks")).where("vec_id IS NOT NULL AND w IS NOT NULL")
    every = usable.groupBy("vec_id").agg(F.min("w").alias("w"), F.max("asks").alias("asks"))
    huge = F.exists("w", lambda x: F.abs(x) > HUGE) | (F.size("w") > LONG)
    every = materialize(every.withColumn("huge", huge), "vectors")
    vectors = every.where(~F.col("huge")).select("vec_id", F.transform("w", lambda x: x.cast("long")).alias("v"), "asks")
    apart = every.where("huge")
    if apart.isEmpty():
        return _indexed(vectors, k)
    beside = _exact(apart.where("asks"), every, k).union(_exact(every.where("asks AND NOT huge"), apart, k))
    inside = _indexed(vectors, k).select("query_id", "vec_id", "score")
    return _ranked(materialize(beside.union(inside), "beside"), k).select("query_id", "rank", "vec_id", "score")


def _indexed(vectors: DataFrame, k: int) -> DataFrame:
    """The same for vectors (vec_id, v, asks) of numbers that fit."""
    built = build(vectors, k)
    if built is None:
        return vectors.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id",
                              F.col("vec_id").alias("score")).where(F.lit(False))
    placed, index = built
    queries = vectors.where("asks").select("vec_id", "v")
    parts = max(1, -(-queries.count() // QUERY_PART))
    infinite = F.lit(float("inf")).alias("kth")
    near = materialize(_ranked(
        _search(placed, _asked(queries.select("vec_id", "v", infinite), index, parts, True), index, parts), k), "near")
    last = near.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("s")).select(
        F.col("query_id").alias("vec_id"), "s")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    kth = F.sqrt(F.greatest(F.lit(0.0), square + float(index.longest) - 2.0 * F.col("s")))
    bounded = queries.join(last, "vec_id", "left").select(
        "vec_id", "v", F.when(F.col("s").isNotNull(), kth).otherwise(float("inf")).alias("kth"))
    rest = _search(placed, _asked(bounded, index, parts, False), index, parts)
    return _ranked(near.select("query_id", "vec_id", "score").union(rest), k).select("query_id", "rank", "vec_id", "score")
