"""Language identification in two steps: family first, then pairs within it.

Texts become hashed counts of letter groups (one to three bytes, case and marks
between words folded), square-rooted and scaled to length one. The languages
seen in training are grouped into families by the similarity of their mean
texts. One linear support vector machine per family picks the family; inside,
one machine per pair of languages votes.

Training takes at most ``SAMPLE`` texts of each language, those with the smallest
hash of their key, and at most ``TOTAL``, or one of each language if they are more.
That is the only bound; every language is learned, every text predicted, whole. The
model grows with the languages: above ``MANY`` of them a family has at most ``FAMILY``.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
so is every text if nothing can be learned. Rows without a language are never
learned from. Ties go to the language that sorts first. Repeated rows get
repeated results; an empty table gives an empty table; columns besides the
named ones never matter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.rows import per_text

#: Most labelled texts learned from, per language.
SAMPLE = 300
#: With more languages families stay small: pairs within them would grow with the square.
MANY, FAMILY = 200, 16
#: Most labelled texts over all languages: with many of them each gets fewer.
TOTAL = 12_000
BITS = 12
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")  # letters, and number signs such as the Roman numeral four
#: ASCII that is no letter counts as a gap.
_FOLD = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))


def has_letter(text: str) -> bool:
    return any(found[0].isalpha() for found in _LETTER.finditer(text))


def features(text: str):
    """Unit vector of a text, float32; None without a letter."""
    import numpy as np

    if not text or not has_letter(text):
        return None
    data = b" " + text.lower().encode("utf-8").translate(_FOLD) + b" "
    total = np.zeros(1 << BITS, dtype=np.float64)
    for at in range(0, len(data), 1 << 20):
        raw = np.frombuffer(data[at:at + (1 << 20) + 2], dtype=np.uint8).astype(np.uint32)
        code = raw[:0]
        for n in range(1, 4):
            code = raw if n == 1 else (code[:-1] << np.uint32(8)) | raw[n - 1:]
            own = code[: 1 << 20]
            own = own[own != sum(32 << 8 * k for k in range(n))]
            slot = (own + np.uint32(n)) * np.uint32(2654435761) >> np.uint32(32 - BITS)
            total += np.bincount(slot, minlength=1 << BITS)
    total = np.sqrt(total)
    return (total / np.linalg.norm(total)).astype(np.float32)


def _machine(x, y, rounds: int = 12, c: float = 10.0):
    """A linear support vector machine (weights, bias last) by dual coordinate descent; y is +1 or -1."""
    import numpy as np

    x = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
    w, alpha = np.zeros(x.shape[1], dtype=np.float32), np.zeros(len(x))
    norms = (x * x).sum(axis=1)
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(len(x)):
            step = alpha[i] - (y[i] * float(x[i] @ w) - 1) / norms[i]
            step = min(max(step, 0.0), c)
            if step != alpha[i]:
                w += np.float32((step - alpha[i]) * y[i]) * x[i]
                alpha[i] = step
    return w


@dataclass
class Model:
    languages: list[str]
    families: list[list[int]] = field(default_factory=list)
    family_weights: object = None  # a row per family
    pair_weights: dict = field(default_factory=dict)  # (i, j) -> weights, positive for i

    def predict(self, x) -> tuple[str, float]:
        import numpy as np

        x = np.append(x, np.float32(1))
        sure, at = 1.0, 0
        if len(self.families) > 1:
            margins = self.family_weights @ x
            at = int(margins.argmax())
            sure = _squash(margins[at] - np.delete(margins, at).max())
        members = self.families[at]
        votes = {m: [0, 0.0] for m in members}
        for i, a in enumerate(members):
            for b in members[i + 1:]:
                margin = float(self.pair_weights[a, b] @ x)
                votes[a if margin >= 0 else b][0] += 1
                votes[a][1] += margin
                votes[b][1] -= margin
        best = min(members, key=lambda m: (-votes[m][0], -votes[m][1], m))
        if len(members) > 1:
            sure *= min(_squash(2 * (self.pair_weights[best, o] @ x if best < o else -(self.pair_weights[o, best] @ x)))
                        for o in members if o != best)
        return self.languages[best], float(sure)


def _squash(margin) -> float:
    import math

    return 1 / (1 + math.exp(-min(max(2 * float(margin), -60.0), 60.0)))


def _families(means) -> list[list[int]]:
    """Average linkage down to about the root of the number of languages."""
    import numpy as np

    groups = [[i] for i in range(len(means))]
    alike, sizes = means @ means.T, np.ones(len(means))  # sums over the pairs of two groups
    most = FAMILY if len(means) > MANY else len(means)
    while len(groups) > max(1, round(len(means) ** 0.5)):
        free = np.triu(sizes[:, None] + sizes <= most, 1)
        if not free.any():
            break
        a, b = divmod(int(np.where(free, alike / np.outer(sizes, sizes), -np.inf).argmax()), len(groups))
        groups[a] = sorted(groups[a] + groups.pop(b))
        alike[a] += alike[b]
        alike[:, a] += alike[:, b]
        sizes[a] += sizes[b]
        alike, sizes = np.delete(np.delete(alike, b, 0), b, 1), np.delete(sizes, b)
    return groups


def fit(names: list[str], x) -> Model:
    """A model from labelled vectors."""
    import numpy as np

    known = sorted(set(names))
    y = np.array([known.index(n) for n in names])
    model = Model(known)
    if not known:
        return model
    means = np.stack([x[y == k].mean(axis=0) for k in range(len(known))])
    centred = means - means.mean(axis=0)
    centred /= np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-9)
    model.families = _families(centred)
    if len(model.families) > 1:
        model.family_weights = np.stack([
            _machine(x, np.where(np.isin(y, f), 1.0, -1.0)) for f in model.families])
    for members in model.families:
        for i, a in enumerate(members):
            for b in members[i + 1:]:
                own = (y == a) | (y == b)
                model.pair_weights[a, b] = _machine(x[own], np.where(y[own] == a, 1.0, -1.0))
    return model


def train(rows: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` rows of each language."""
    import numpy as np

    named = rows.select(rows[key].alias("key"), rows[lang].alias("lang"), rows[text].alias("text")).where(
        "lang IS NOT NULL AND text IS NOT NULL").withColumn(
        "rank", F.xxhash64(F.coalesce(F.col("key").cast("string"), F.lit("")), "text"))
    counts = named.groupBy("lang").count().collect()  # a row per language
    if not counts:
        return Model([])
    sample = max(1, min(sample, TOTAL // len(counts)))
    # the hash is even, so a share of its range is a share of the rows: a third more than wanted, then the least
    cuts = rows.sparkSession.createDataFrame(
        [(r["lang"], min(int((1.3 * sample + 60) / r["count"] * 2**64) - 2**63, 2**63 - 1)) for r in counts],
        "lang string, cut long")
    share = named.join(F.broadcast(cuts), "lang").where("rank <= cut").select("key", "lang", "text", "rank")

    def vectors(batches):
        for batch in batches:
            found = [features(t) for t in batch.column("text").to_pylist()]
            keep = [i for i, f in enumerate(found) if f is not None]
            part = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [part.column("lang"), part.column("rank"),
                 pa.array([found[i].astype("<f2").tobytes() for i in keep], pa.binary())], ["lang", "rank", "x"])

    # repeated rows have one hash, so the share alone is no bound
    first = Window.partitionBy("lang").orderBy("rank", "x")
    got = share.mapInArrow(vectors, "lang string, rank long, x binary").withColumn(
        "n", F.row_number().over(first)).where(F.col("n") <= sample).collect()
    got.sort(key=lambda r: (r.lang, r.rank, r.x))
    taken: dict[str, list] = {}
    for r in got:
        if len(taken.setdefault(r.lang, [])) < sample:
            taken[r.lang].append(np.frombuffer(r.x, dtype="<f2").astype(np.float32))
    names = [n for n, v in taken.items() for _ in v]
    return fit(names, np.array([v for n in taken for v in taken[n]], dtype=np.float32))


def held_out(key: Column, parts: int = 4, part: int = 2) -> Column:
    """Rows never learned from, by a checksum of the key; a null key is not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == part, F.lit(False))


def identify(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every row; no shuffle."""
    shipped = df.sparkSession.sparkContext.broadcast(model)  # languages and features are bounded

    def one():
        known = shipped.value

        def predict(t: str) -> tuple:
            x = features(t) if known.languages else None
            return (UNKNOWN, 0.0) if x is None else known.predict(x)

        return predict

    return per_text(df, key, text, one, ["lang_pred", "score"], [pa.string(), pa.float64()],
                    "lang_pred string, score double")


def language_of(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, held_out, lang_pred, score), learned from the rows that are not held out."""
    model = train(df.where(~held_out(df[key])), key, text, lang)
    return identify(df, model, key, text).select(key, held_out(F.col(key)).alias("held_out"), "lang_pred", "score")


def keep_identified(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows that hold language at all, every column as it was.

    A text goes if nothing in it is a letter; so texts stay if no language could be
    learned, because none is labelled or all labelled rows are held out. How sure
    the machines are never drops a text: a language nobody labelled is one too.
    """
    model = train(df.where(~held_out(df[key])), key, text, lang)
    shipped = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        at = batches  # whole rows pass through, so nothing has to be joined back
        for batch in at:
            texts = batch.column(text).to_pylist()
            keep = []
            for t in texts:
                x = features(t)
                keep.append(x is not None and (
                    not shipped.value.languages or shipped.value.predict(x)[0] != UNKNOWN))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, df.schema)
