"""Glossaries: profile selection and terms contained in texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions.tokens import term_automaton

#: Sources that one automaton holds, and texts that meet one shard at a time.
SHARD_BYTES, BLOCK_BYTES = 8 << 20, 64 << 20


def select_profile(terms: DataFrame, profile: str) -> DataFrame:
    """Terms of a profile; without such a profile the flat entries (NULL profile)."""
    named = terms.where(F.col("profile") == profile)
    flat = terms.where(F.col("profile").isNull())
    exists = named.agg((F.count("*") > 0).alias("_named"))  # one row
    tagged = named.withColumn("_own", F.lit(True)).unionByName(flat.withColumn("_own", F.lit(False)))
    return (
        tagged.join(F.broadcast(exists)).where(F.col("_own") == F.col("_named"))
        .select("source", "target")
    )


def as_lines(terms: DataFrame) -> DataFrame:
    """Render ``source => target`` lines; blank sources are left out."""
    return terms.where(F.col("source") != "").withColumn(
        "line", F.concat_ws(" => ", "source", "target")
    )


def contained_terms(texts: DataFrame, terms: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The key with all term columns, for every glossary term that occurs in a text.

    An automaton over the sources passes every text once and reports matches; only
    these, one row per text and term, meet the other term columns. Up to
    ``SHARD_BYTES`` of sources travel to the tasks as they are, after their size was
    checked. A larger glossary is cut into shards of that size by a hash of the
    source, and blocks of texts meet each shard. ``key`` tells the texts apart.
    """
    kept = terms.columns
    terms = terms.where(F.col("source") != "")
    size = terms.agg(F.sum(F.octet_length("source"))).first()[0] or 0
    if size <= SHARD_BYTES:
        sources = [r[0] for r in terms.select("source").distinct().collect()]
        found = _matches(texts.select(key, text), sources)
    else:
        found = _sharded_matches(texts.select(key, text), terms.select("source").distinct(), -(-size // SHARD_BYTES))
    return found.withColumnRenamed("_key", key).join(terms, "source").select(key, *kept)


def _hits(automaton, keys: pa.Array, texts: list) -> tuple[list[int], list[str]]:
    """Row numbers and sources of the distinct matches of each text."""
    at, sources = [], []
    for n, t in enumerate(texts):
        own = {source for _, source in automaton.iter(t)} if t else ()
        at += [n] * len(own)
        sources += own
    return at, sources


def _matches(texts: DataFrame, sources: list[str]) -> DataFrame:
    """(_key, source) for sources that the tasks hold whole."""
    if not sources:
        return texts.select(F.col(texts.columns[0]).alias("_key"), F.lit("").alias("source")).where(F.lit(False))
    shipped = texts.sparkSession.sparkContext.broadcast(sources)  # SHARD_BYTES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = term_automaton(shipped.value)
        for batch in batches:
            at, found = _hits(automaton, batch.column(0), batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], ["_key", "source"])

    return texts.mapInArrow(run, f"_key {texts.dtypes[0][1]}, source string")


def _sharded_matches(texts: DataFrame, sources: DataFrame, shards: int) -> DataFrame:
    """The same for sources of any number: blocks of texts times shards, each pair in a task of its own."""
    key, text = texts.columns
    volume = texts.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(1, -(-volume // BLOCK_BYTES))

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = texts.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("_block"), every(shards).alias("_shard"))
    right = sources.select("source", F.pmod(F.xxhash64("source"), F.lit(shards)).cast("int").alias("_shard"), every(blocks).alias("_block"))

    def one(some: pa.Table, own: pa.Table) -> pa.Table:
        at, found = ([], []) if not (some.num_rows and own.num_rows) else _hits(
            term_automaton(own["source"].to_pylist()), some["_key"], some["_text"].to_pylist())
        return pa.table({"_key": some["_key"].take(pa.array(at, pa.int64())), "source": pa.array(found, pa.string())})

    pair = ["_block", "_shard"]
    return left.groupBy(*pair).cogroup(right.groupBy(*pair)).applyInArrow(one, f"_key {texts.dtypes[0][1]}, source string")


def own_terms(contained: DataFrame, key: str) -> DataFrame:
    """Per text the ARRAY of its (source, target, ord) terms, longest first, ties by ``ord``.

    The array is as large as the number of terms one text contains.
    """
    entry = F.struct(
        (-F.length("source")).alias("rank"), F.col("ord").alias("ord"),
        F.col("source").alias("source"), F.col("target").alias("target"),
    )
    return (
        contained.groupBy(key)
        .agg(F.array_sort(F.collect_list(entry)).alias("_terms"))
        .select(key, F.transform("_terms", lambda t: F.struct(t["source"], t["target"])).alias("terms"))
    )
