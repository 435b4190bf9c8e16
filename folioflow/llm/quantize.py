"""Vector code compression: product quantisation in whole numbers, exact on BLAS.

Components become floor(1024 * x). Vectors are cut into equal parts; the codebook of
a part position starts from the rows of smallest id and is improved by rounds of
nearest entry and component-wise floor(sum / count). Everything is exact: a distance
is |b|^2 - 2ab + |a|^2 in int64, and the products ab come from float64 matrix
products over limbs: whole numbers are broken into limbs so narrow that no sum of
limb products reaches 2^53, and the limb products are shifted and added in int64.
The first least distance gives the code.

Each round is one pass over the written vectors. A task sends, for every entry it
used, one row with the count and the sums, in limbs of 30 bits; these are added up
per entry. So what is shuffled depends on tasks and codebook, not on vectors, and
only the codebooks (``parts * entries * size / parts`` numbers) pass the driver.

Numbers of any size: where a squared distance could leave int64, because of a huge
finite component, the same rules run over Python integers, for the rows and entries
concerned only.

Defined results: vectors that are null, or hold a null, NaN or infinite component,
are dropped, a component that overflows a double when scaled counting as infinite;
shorter vectors count as filled up with zeros, all up to a multiple of the number of parts; of several rows with one id
the smallest vector starts the codebook, rows without an id start none, but every
kept row is coded and counts in the means; fewer ids than entries give a shorter
codebook; an error beyond a long is null, and so is the sum of its label; an empty
table gives an empty table; columns besides the named ones never matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.operators.skew import heavy_keys, join_unique
from folioflow.session import materialize

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Rows that are compared with a codebook at once.
ROWS = 4096
LIMB = 30
_LONG = 2**63 - 1


def whole(values):
    """floor(1024 * x) of float64 values, as float64: exact, since scaling by a power of two is."""
    import numpy as np

    return np.floor(values * SCALE)


def limbs(matrix, bits: int, count: int):
    """float64 limbs of int64 numbers, lowest first; the highest carries the sign."""
    import numpy as np

    out, rest = [], matrix
    for _ in range(count - 1):
        high = rest >> bits
        out.append((rest - (high << bits)).astype(np.float64))
        rest = high
    return [*out, rest.astype(np.float64)]


def exact_products(a, b):
    """``a @ b.T`` of int64 matrices whose result fits int64, by float64 products of limbs."""
    import numpy as np

    size = max(1, a.shape[1])
    bits = (53 - size.bit_length()) // 2  # size * 2^(2 * bits) <= 2^53
    largest = max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0)))
    count = max(1, -(-(largest.bit_length() + 1) // bits))
    left, right = limbs(a, bits, count), limbs(b, bits, count)
    out = np.zeros((len(a), len(b)), dtype=np.int64)
    for i in range(count):
        for j in range(count):
            out += (left[i] @ right[j].T).astype(np.int64) << (bits * (i + j))
    return out


def safe_bound(size: int) -> int:
    """Numbers up to this give squared distances of ``size`` components below 2^62."""
    return int((2**62 / max(1, size)) ** 0.5 / 2) - 1


def _in_full(a, b):
    """First nearest entry and its distance over Python integers, a row at a time."""
    import numpy as np

    codes, errors = [], []
    for row in a:
        away = ((b - row) ** 2).sum(axis=1)
        at = min(range(len(b)), key=lambda i: (away[i], i))
        codes.append(at)
        errors.append(int(away[at]))
    return np.array(codes, dtype=np.int64), errors


class Codebook:
    """Entries of one part position, as Python integers; ready for int64 where they are small."""

    def __init__(self, entries, bound: int):
        import numpy as np

        self.entries = np.array(entries, dtype=object).reshape(len(entries), -1)
        self.bound = bound
        size = np.array([max(map(abs, e), default=0) for e in self.entries], dtype=object)
        self.near = np.flatnonzero(size <= bound)
        self.small = self.entries[self.near].astype(np.int64)
        self.squares = (self.small**2).sum(axis=1)
        huge = [int(s) for s in size if s > bound]
        self.least_huge = min(huge) if huge else None

    def nearest(self, rows):
        """(codes, errors) of rows of whole float64 numbers: first nearest entries and squared distances."""
        import numpy as np

        codes = np.zeros(len(rows), dtype=np.int64)
        errors = np.zeros(len(rows), dtype=object)
        largest = np.abs(rows).max(axis=1, initial=0)
        plain = largest <= self.bound
        if len(self.small) and plain.any():
            at = np.flatnonzero(plain)
            a = rows[at].astype(np.int64)
            away = self.squares[None, :] - 2 * exact_products(a, self.small)
            best = away.argmin(axis=1)
            codes[at] = self.near[best]
            found = away[np.arange(len(at)), best] + (a**2).sum(axis=1)
            errors[at] = found
            if self.least_huge is not None:
                # a huge entry differs by more than this in one component; nearer ones are settled
                least = (self.least_huge - largest[at]) ** 2 * (1 - 1e-9)
                plain[at] = found < least
        else:
            plain[:] = False
        rest = np.flatnonzero(~plain)
        if len(rest):
            exact = np.array([[int(x) for x in r] for r in rows[rest]], dtype=object).reshape(len(rest), -1)
            codes[rest], errors[rest] = _in_full(exact, self.entries)
        return codes, errors


class Model:
    """Codebooks of all part positions."""

    def __init__(self, width: int, books: list):
        self.width = width  # components of a part
        bound = safe_bound(width * len(books))
        self.books = [Codebook(b, bound) for b in books]

    def parts(self, matrix) -> Iterator:
        for p in range(len(self.books)):
            yield matrix[:, p * self.width:(p + 1) * self.width]

    def digest(self) -> str:
        told = hashlib.sha256()
        told.update(",".join(str(x) for b in self.books for e in b.entries for x in e).encode())
        return told.hexdigest()


def matrix_of(column: pa.Array, size: int):
    """Rows of float64 lists as one matrix, filled up with zeros."""
    import numpy as np

    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    if len(lengths) and (lengths == size).all():
        return flat.reshape(-1, size)
    out = np.zeros((len(lengths), size))
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def finite_vectors(rows: DataFrame, key: str, vector: str, scale: int, *more: str) -> DataFrame:
    """(key, v array<double>, more) of the rows whose vector is complete, and finite when scaled."""
    real = F.transform(rows[vector], lambda x: x.cast("double"))
    good = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * float(scale) < float("inf")))
    return rows.select(rows[key].alias("key"), real.alias("v"), *[rows[m].alias(m) for m in more]).where(
        F.col("v").isNotNull() & good)


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Model | None:
    """vectors (key, v) -> the codebooks after ``rounds`` rounds; None without vectors."""
    longest = vectors.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return None
    width = max(1, -(-longest // parts))
    ids = vectors.where("key IS NOT NULL").select("key").distinct().orderBy("key").limit(entries).agg(F.max("key")).first()[0]
    first = vectors.where(F.col("key") <= ids).groupBy("key").agg(F.min("v").alias("v")).orderBy("key").collect()  # one row per entry
    if not first:  # no row has an id
        first = vectors.select("v").distinct().orderBy("v").limit(entries).collect()
    start = matrix_of(pa.array([r.v for r in first], pa.list_(pa.float64())), width * parts)
    whole_start = [[int(x) for x in r] for r in whole(start)]
    model = Model(width, [[r[p * width:(p + 1) * width] for r in whole_start] for p in range(parts)])
    for _ in range(rounds):
        model = improved(vectors, model)
    return model


def used_entries(vectors: DataFrame, model: Model) -> DataFrame:
    """Of each task one row (part, code, n, sums) for every entry that is nearest to some part."""
    shipped = vectors.sparkSession.sparkContext.broadcast(model)  # a codebook has a fixed number of entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        known = shipped.value
        count = [np.zeros(len(b.entries), dtype=np.int64) for b in known.books]
        sums = [np.zeros(b.entries.shape, dtype=object) for b in known.books]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                matrix = whole(matrix_of(batch.column(0).slice(at, ROWS), known.width * len(known.books)))
                for p, part in enumerate(known.parts(matrix)):
                    codes, _ = known.books[p].nearest(part)
                    count[p] += np.bincount(codes, minlength=len(count[p]))
                    plain = np.abs(part).max(axis=1, initial=0) <= known.books[p].bound
                    order = np.argsort(codes[plain], kind="stable")
                    if len(order):
                        own = codes[plain][order]
                        cut = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                        sums[p][own[cut]] += np.add.reduceat(part[plain][order].astype(np.int64), cut, axis=0)
                    for i in np.flatnonzero(~plain):
                        sums[p][codes[i]] += np.array([int(x) for x in part[i]], dtype=object)
        used = [(p, int(c), int(count[p][c]), _packed(sums[p][c])) for p in range(len(count)) for c in np.flatnonzero(count[p])]
        if used:
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*used), kinds)], ["part", "code", "n", "sums"])

    return vectors.select("v").mapInArrow(run, "part int, code int, n long, sums array<array<long>>")


def improved(vectors: DataFrame, model: Model) -> Model:
    """One round: assign every part, then move each used entry to the floored mean of its parts."""

    def added(table: pa.Table) -> pa.Table:
        total, values = 0, None
        for n, packed in zip(table["n"].to_pylist(), table["sums"].to_pylist()):
            own = [_unpacked(x) for x in packed]
            total += n
            values = own if values is None else [a + b for a, b in zip(values, own)]
        mean = [str(v // total) for v in values]
        return pa.table({"part": table["part"][:1], "code": table["code"][:1], "mean": pa.array([mean], pa.list_(pa.string()))})

    books = [b.entries.tolist() for b in model.books]
    for r in used_entries(vectors, model).groupBy("part", "code").applyInArrow(added, "part int, code int, mean array<string>").collect():
        books[r.part][r.code] = [int(x) for x in r["mean"]]
    return Model(model.width, books)


def _packed(values) -> list[list[int]]:
    """Whole numbers of any size as limbs of 30 bits, lowest first."""
    out = []
    for v in values:
        v, low = int(v), []
        while not -(2**62) < v < 2**62:
            low.append(v & ((1 << LIMB) - 1))
            v >>= LIMB
        out.append([*low, v])
    return out


def _unpacked(low: list[int]) -> int:
    value = 0
    for x in reversed(low):
        value = (value << LIMB) + x
    return value


def encode(vectors: DataFrame, model: Model, *more: str) -> DataFrame:
    """vectors (key, v, more) -> (key, more, code, error): the codes of every part, and the squared distance."""
    shipped = vectors.sparkSession.sparkContext.broadcast(model)
    wanted = vectors.select("v", "key", *more)
    kept = [f.name for f in wanted.schema][1:]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema.fields[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                piece = batch.slice(at, ROWS)
                matrix = whole(matrix_of(piece.column(0), known.width * len(known.books)))
                codes = ["" for _ in range(len(matrix))]
                error = [0] * len(matrix)
                for book, part in zip(known.books, known.parts(matrix)):
                    own, away = book.nearest(part)
                    codes = [c + f"{x:02x}" for c, x in zip(codes, own.tolist())]
                    error = [e + int(x) for e, x in zip(error, away)]
                yield pa.RecordBatch.from_arrays(
                    [*[piece.column(c) for c in kept], pa.array(codes, pa.string()),
                     pa.array([e if e <= _LONG else None for e in error], pa.int64())], [*kept, "code", "error"])

    return wanted.mapInArrow(run, f"{schema}, code string, error long")


def compress(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of every kept row."""
    vectors = materialize(finite_vectors(rows, key, vector, SCALE, label).select(
        "key", "v", F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("")).alias("label")), "vectors")
    model = train(vectors, parts, entries, rounds)
    if model is None:
        return vectors.select(F.col("key").alias(key), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
                              F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")).where(F.lit(False))
    coded = materialize(encode(vectors, model, "label"), "codes")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    fits = (F.count("error") == F.count("*")) & (total <= _LONG)
    labels = coded.groupBy("label").agg(F.count("*").alias("n"), F.when(fits, total.cast("long")).alias("label_error"))
    joined = join_unique(coded, labels.drop("n"), "label", heavy_keys(labels, "label"), ["key"], "inner")
    return joined.select(F.col("key").alias(key), "code", "error", "label_error", F.lit(model.digest()).alias("codebooks_sha256"))
