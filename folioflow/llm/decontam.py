"""Benchmark decontamination with DataFrame functions only.

The windows of a benchmark (ten consecutive words, or all words of a shorter
item) become a hash set. Every training window is hashed in its row, probed
against the set, and what the set lets through is verified word by word on the
original text; so neither the hash nor the cheap letter folding of the first
pass can decide a result.

The set is broadcast if its rows were counted and are at most ``MAX_BROADCAST``;
beyond that the same join runs by shuffle. Found positions are written to the
shared folder before they meet the texts again, broadcast under the same check.

Defined results: null texts and texts without words have no windows and are not
contaminated; documents are told apart by key and text, so repeated rows all
get the same, whole result; a null key is a key like any other; items without
words match nothing; items with a null id mark words but are not listed; other
columns never matter; an empty benchmark finds nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.binding import let
from folioflow.session import materialize

WINDOW = 10
MAX_BROADCAST = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Anything but letters, digits and all beyond ASCII; in either case, so that counting need not fold it.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _split(text: Column) -> Column:
    return F.array_remove(F.split(text, _BETWEEN), "")


def words(text: Column) -> Column:
    """Words after lower-casing A-Z, and nothing else."""
    return _split(F.translate(text, _UPPER, _LOWER))


def _folded_hashes(text: Column) -> Column:
    """A hash per word, equal at least where the words are.

    lower() is far cheaper than translate(). It changes letters one by one, but
    for a capital sigma, which looks at its neighbours and is replaced before.
    """
    return F.transform(_split(F.lower(F.replace(text, F.lit("Σ"), F.lit("σ")))), lambda w: F.xxhash64(w))


def _window_hasher(size: int) -> Callable[[Column], Column]:
    """From word hashes to the hashes of all windows of one size."""
    return lambda hashes: F.when(
        F.size(hashes) >= size,
        F.transform(F.sequence(F.lit(1), F.size(hashes) - (size - 1)),
                    lambda i: F.xxhash64(F.slice(hashes, i, size))),
    )


def benchmark_windows(items: DataFrame, item: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """(item, len, window, hash): every window of every item, once."""
    cut = items.select(items[item].alias("item"), words(items[text]).alias("w"),
                       _folded_hashes(items[text]).alias("h")).where("size(w) > 0")
    cut = cut.withColumn("len", F.least(F.size("w"), F.lit(size)))
    spot = F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("i")
    return cut.select("item", "len", "w", "h", spot).select(
        "item", "len", F.array_join(F.slice("w", F.col("i"), F.col("len")), " ").alias("window"),
        F.xxhash64(F.slice("h", F.col("i"), F.col("len"))).alias("hash"),
    ).distinct()


def _checked(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MAX_BROADCAST else df


def verified_windows(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
                     item: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """(key, print, hits, items) of documents that hold a window.

    ``print`` tells texts of one key apart; ``hits`` are (pos, len) with pos from
    0, ``items`` the ids of the items found.
    """
    windows = materialize(benchmark_windows(items, item, item_text, size), "benchmark-windows")
    known = windows.count()
    lengths = sorted(r[0] for r in windows.select("len").distinct().collect())  # at most ``size`` rows
    source = docs.select(docs[key].alias("key"), docs[text].alias("text")).where("text IS NOT NULL").withColumn(
        "print", F.xxhash64("text"))
    found = None
    for n in lengths:
        wanted = windows.where(F.col("len") == n).select("hash").distinct()
        hashes = let(_folded_hashes(F.col("text")), _window_hasher(n))
        probe = source.select("key", "print", F.posexplode(hashes).alias("pos", "hash"))
        hit = probe.join(_checked(wanted, known), "hash", "left_semi").select(
            "key", "print", "pos", F.lit(n).alias("len"))
        found = hit if found is None else found.union(hit)
    if found is None:
        found = source.where(F.lit(False)).select("key", "print", F.lit(0).alias("pos"), F.lit(0).alias("len"))
    spots = materialize(
        found.groupBy("key", "print").agg(F.collect_set(F.struct("pos", "len")).alias("spots")),  # one text's windows
        "candidate-windows")
    size_now = spots.agg(F.coalesce(F.sum(F.size("spots")), F.lit(0))).first()[0]
    spots = spots.select(F.col("key").alias("_k"), F.col("print").alias("_p"), "spots")
    texts = source.join(_checked(spots, size_now), F.col("key").eqNullSafe(F.col("_k")) & (F.col("print") == F.col("_p")))
    exact = texts.select("key", "print", F.explode(let(
        words(F.col("text")), lambda w: F.transform("spots", lambda s: F.struct(
            s["pos"].alias("pos"), s["len"].alias("len"),
            F.array_join(F.slice(w, s["pos"] + 1, s["len"]), " ").alias("window"))))).alias("s"))
    named = windows.groupBy("window", "len").agg(F.collect_set("item").alias("items"))
    proven = exact.select("key", "print", "s.*").join(_checked(named, known), ["window", "len"])
    return proven.groupBy("key", "print").agg(
        F.collect_set(F.struct("pos", "len")).alias("hits"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))


def _hit_words(hits: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(
        hits, lambda h: F.sequence(h["pos"], h["pos"] + h["len"] - 1))))


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
                  item: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated), a row per document."""
    proven = verified_windows(docs, items, key, text, item, item_text, size).select(
        F.col("key").alias("_k"), F.col("print").alias("_p"), F.size(_hit_words(F.col("hits"))).alias("n"), "items")
    proven = materialize(proven, "contaminated")
    counted = docs.select(
        docs[key].alias("_key"), F.xxhash64(docs[text]).alias("_print"),
        F.coalesce(F.size(_split(docs[text])), F.lit(0)).cast("long").alias("n_words"))
    counted = counted.withColumn("n_words", F.greatest("n_words", F.lit(0)))
    joined = counted.join(
        proven, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_print") == F.col("_p")), "left")
    listed = F.array_sort(F.transform(F.coalesce("items", F.array()), lambda i: i.cast("string")))
    return joined.select(
        F.col("_key").alias(key), "n_words", F.coalesce("n", F.lit(0)).cast("long").alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", listed).cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n", F.lit(0)) > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
                      item: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """The documents without a benchmark window, all columns as they were."""
    bad = materialize(verified_windows(docs, items, key, text, item, item_text, size).select(
        F.col("key").alias("_k"), F.col("print").alias("_p")), "contaminated")
    bad = _checked(bad, bad.count())
    return docs.join(
        bad, docs[key].eqNullSafe(bad["_k"]) & (F.xxhash64(docs[text]) == bad["_p"]), "left_anti")


def cut_windows(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
                item: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """The documents with the hit words and what stands around them taken out.

    A touched text keeps its other words with the separators behind them.
    """
    hits = materialize(verified_windows(docs, items, key, text, item, item_text, size).select(
        F.col("key").alias("_k"), F.col("print").alias("_p"), _hit_words(F.col("hits")).alias("_hit")), "hit-words")
    hits = _checked(hits, hits.count())
    joined = docs.join(
        hits, docs[key].eqNullSafe(hits["_k"]) & (F.xxhash64(docs[text]) == hits["_p"]), "left")
    hit = hits["_hit"]
    part = r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)"
    parts = F.regexp_extract_all(docs[text], F.lit(part), 1)
    lead = F.regexp_extract(docs[text], r"^([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)", 1)
    flags = F.map_from_arrays(hit, F.transform(hit, lambda _: F.lit(True)))
    kept = let(flags, lambda flag: F.filter(
        F.transform(parts, lambda x, i: F.struct(x.alias("x"), i.alias("i"))),
        lambda s: ~F.coalesce(F.element_at(flag, s["i"]), F.lit(False))))
    cut = F.concat(lead, F.array_join(F.transform(kept, lambda s: s["x"]), ""))
    rest = F.when(hit.isNull(), docs[text]).otherwise(cut).alias(text)
    return joined.select(*[rest if c == text else docs[c] for c in docs.columns])
