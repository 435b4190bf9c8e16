"""Memo of finished work, kept as an append-only, clustered table.

Every run is a folder ``level=l/seq=n/run=name``. Its rows lie in buckets by the
first ``l + 1`` hexadecimal digits of the key (keys are hashes, so buckets are
even), in sorted files, one per bucket or, of large runs of level 0, up to sixteen,
with Bloom filters on the key. A lookup
names the buckets of its keys and reads no other files; inside a file, row groups
without the keys are skipped. A run is visible once its ``_SUCCESS`` mark is there.

An upsert appends rows; a read takes the newest row of each key. The number of a
run stands in its folder's name, so a new run needs no scan to be the newest.
``compact_runs`` folds the runs of a full level into one run of the next level. It
counts from the moment its list of replaced runs is in place; until then, or if it
is repeated, the replaced runs are still there and read, so nothing can be lost.
``vacuum`` deletes them later.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow import constants as K
from folioflow.functions.keys import glossary_digest, memo_key
from folioflow.operators import blocked
from folioflow.operators.skew import heavy_keys, join_unique
from folioflow.session import shuffles_freed

SCHEMA = (
    "cache_key string, source_text string, translated_text string, source_lang string,"
    " target_lang string, glossary_hash string, created_at timestamp, seq bigint"
)

#: Runs of one level that are folded into one of the next, whose buckets are as many times as many.
FAN = 16
#: Rows of a run are dealt to tasks by so many digits at least.
SPREAD_DIGITS = 2
_RUN = re.compile(r"level=(\d+)/seq=(\d+)/run=([^/]+)$")
_REPLACES = "_replaces.json"


def entries(pairs: DataFrame, source_lang: Column, target_lang: Column, glossary: Column,
            seq: Column, created_at: Column | None = None) -> DataFrame:
    """Memo rows of (text, translated); empty sources and results are skipped."""
    return pairs.where((F.col("text") != "") & (F.col("translated") != "")).select(
        memo_key(F.col("text"), source_lang, target_lang, glossary).alias("cache_key"),
        F.col("text").alias("source_text"),
        F.col("translated").alias("translated_text"),
        source_lang.alias("source_lang"),
        target_lang.alias("target_lang"),
        glossary_digest(glossary).alias("glossary_hash"),
        (F.current_timestamp() if created_at is None else created_at).alias("created_at"),
        seq.cast("bigint").alias("seq"),
    )


def latest(rows: DataFrame, by: str = "seq") -> DataFrame:
    """The newest row of every key; repeated keys are reduced before the shuffle."""
    rest = [c for c in rows.columns if c != "cache_key"]
    return rows.groupBy("cache_key").agg(
        F.max_by(F.struct(*rest), by).alias("_row")
    ).select("cache_key", "_row.*")


def upsert(stored: DataFrame, new: DataFrame) -> DataFrame:
    return latest(stored.unionByName(new))


@dataclass(frozen=True, order=True)
class Run:
    seq: int
    level: int
    name: str
    path: str

    @property
    def id(self) -> str:
        return f"{self.level}/{self.seq}/{self.name}"


def _files(spark: SparkSession, path: str):
    """The file system of a path, and a function that makes paths of it."""
    jvm = spark.sparkContext._jvm
    make = jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def _replaced_by(spark: SparkSession, run: Run) -> list[str] | None:
    """Ids of the runs that a compaction stands for; None if it is no finished one."""
    fs, make = _files(spark, run.path)
    at = make(f"{run.path}/{_REPLACES}")
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def _all_runs(spark: SparkSession, path: str) -> list[Run]:
    """Every finished run; there are few, since full levels are folded."""
    fs, make = _files(spark, path)
    found = fs.globStatus(make(f"{path}/level=*/seq=*/run=*/_SUCCESS")) or []
    out = []
    for status in found:
        folder = status.getPath().getParent().toString()
        level, seq, name = _RUN.search(folder).groups()
        out.append(Run(int(seq), int(level), name, folder))
    return sorted(out)


def runs(spark: SparkSession, path: str) -> list[Run]:
    """The runs to be read, oldest first: of runs with one name the last, without those that a compaction stands for."""
    every, gone = _all_runs(spark, path), set()
    for run in every:
        if run.level:
            replaced = _replaced_by(spark, run)
            gone.update([run.id] if replaced is None else replaced)
    return list({r.name: r for r in every if r.id not in gone}.values())


def _store(rows: DataFrame, run: str, level: int) -> None:
    digits = level + 1
    clustered = rows.drop("seq").withColumn("bucket", F.substring("cache_key", 1, digits))
    # sixteen buckets alone would be sixteen tasks, however large the run
    with shuffles_freed(rows.sparkSession):
        (
            clustered.repartition(F.substring("cache_key", 1, max(digits, SPREAD_DIGITS))).sortWithinPartitions("bucket", "cache_key")
            .write.mode("overwrite").partitionBy("bucket")
            .option("parquet.bloom.filter.enabled#cache_key", "true")
            .option("parquet.bloom.filter.adaptive.enabled", "true")
            .option("compression", "zstd")
            .parquet(run)
        )


def append(rows: DataFrame, path: str, run: int | str) -> None:
    """Write the rows of one run, as the newest, whatever their ``seq``; repeating a run replaces it.

    Writers that don't know of each other need names of their own for ``run``,
    such as a query's id and its batch number.
    """
    spark = rows.sparkSession
    seq = next_seq(spark, path)
    older = [r for r in _all_runs(spark, path) if r.name == str(run)]
    _store(rows, f"{path}/level=0/seq={seq}/run={run}", 0)
    _delete(spark, [r.path for r in older])


def next_seq(spark: SparkSession, path: str) -> int:
    """A number above all that the table holds, so that a new run is newer; read from the folders' names."""
    return max((r.seq for r in _all_runs(spark, path)), default=-1) + 1


def create_empty(spark: SparkSession, path: str) -> None:
    fs, make = _files(spark, path)
    fs.mkdirs(make(path))


def _read(spark: SparkSession, path: str, chosen: Iterable[Run], buckets: Iterable[str] | None = None) -> DataFrame:
    """Rows of some runs; with ``buckets`` (full keys or their beginnings) only of files that can hold them."""
    wanted = None if buckets is None else sorted(set(buckets))
    by_level: dict[int, list[str]] = {}
    for run in chosen:
        by_level.setdefault(run.level, []).append(run.path)
    frames = []
    for level, folders in sorted(by_level.items()):
        rows = spark.read.schema(f"{SCHEMA}, level int, run string, bucket string").option("basePath", path).parquet(*folders)
        if wanted is not None:
            rows = rows.where(F.col("bucket").isin(sorted({b[:level + 1] for b in wanted})))
        frames.append(rows.drop("level", "run", "bucket"))
    return reduce(DataFrame.unionByName, frames) if frames else _no_rows(spark)


def _no_rows(spark: SparkSession) -> DataFrame:
    """An empty memo, without a Python task."""
    columns = (c.strip().split(" ") for c in SCHEMA.split(","))
    return spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in columns])


def stored_rows(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, runs(spark, path))


def other_rows(spark: SparkSession, path: str, run: str) -> DataFrame:
    """All rows but those of one run, which a repeated attempt is about to replace."""
    return _read(spark, path, [r for r in runs(spark, path) if r.name != run])


def rows_for(work: DataFrame, path: str, but: str | None = None) -> DataFrame:
    """Rows of the files that can hold the keys of ``work`` (a table: it is read once for its buckets).

    The buckets of the finest level are collected, 16 ** (level + 1) at most and
    4096 in any case; a batch of work that is small beside the memo leaves most files out.
    """
    spark = work.sparkSession
    chosen = [r for r in runs(spark, path) if r.name != but]
    digits = min(3, max((r.level for r in chosen), default=0) + 1)
    asked = [r[0] for r in work.select(F.substring("cache_key", 1, digits)).distinct().collect()]
    # a beginning shorter than a level's buckets cannot choose among them
    fine = [r for r in chosen if r.level + 1 <= digits]
    rows = _read(spark, path, fine, asked)
    deeper = [r for r in chosen if r.level + 1 > digits]
    return rows if not deeper else rows.unionByName(_read(spark, path, deeper))


def lookup(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest rows of a few keys: only their buckets are opened, and row groups without them skipped."""
    held = _read(spark, path, runs(spark, path), keys)
    return latest(held.where(F.col("cache_key").isin(*keys)))


def load(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of every key."""
    return latest(stored_rows(spark, path))


def compact_runs(spark: SparkSession, path: str, fan: int = FAN) -> int:
    """Fold every level that holds ``fan`` runs or more into the next; returns how many levels were folded."""
    folded, level = 0, 0
    while True:
        every = runs(spark, path)
        mine = [r for r in every if r.level == level]
        if len(mine) >= fan:
            _fold(spark, path, mine)
            folded += 1
        elif not any(r.level > level for r in every):
            return folded
        level += 1


def _fold(spark: SparkSession, path: str, mine: list[Run]) -> None:
    ids = [r.id for r in mine]
    name = "fold-" + hashlib.sha256("\n".join(ids).encode()).hexdigest()[:16]
    level = mine[0].level + 1
    target = f"{path}/level={level}/seq={max(r.seq for r in mine)}/run={name}"
    _store(latest(_read(spark, path, mine)), target, level)
    fs, make = _files(spark, path)
    draft = make(f"{target}/{_REPLACES}.draft")
    stream = fs.create(draft, True)
    stream.write(bytearray(json.dumps(ids).encode()))
    stream.close()
    fs.rename(draft, make(f"{target}/{_REPLACES}"))


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete the folders that no reader needs any more; call it when no reader of an older state is left."""
    kept = {r.path for r in runs(spark, path)}
    gone = [r.path for r in _all_runs(spark, path) if r.path not in kept and (r.level == 0 or _replaced_by(spark, r) is not None)]
    _delete(spark, gone)
    return len(gone)


def _delete(spark: SparkSession, folders: Iterable[str]) -> None:
    for folder in folders:
        fs, make = _files(spark, folder)
        fs.delete(make(folder), True)


def compact(spark: SparkSession, path: str, into: str) -> None:
    """Write one row per key to a new snapshot."""
    append(load(spark, path), into, 0)


def clear(spark: SparkSession, path: str) -> None:
    """Truncate: the table keeps its folder and no run."""
    fs, make = _files(spark, path)
    _delete(spark, [s.getPath().toString() for s in fs.globStatus(make(f"{path}/level=*")) or []])


def _octets() -> Column:
    return (F.octet_length("source_text") + F.octet_length("translated_text")).cast("bigint").alias("octets")


def stats(memo: DataFrame) -> DataFrame:
    """Number of rows and megabytes of text held."""
    return _totals(memo.select(_octets()))


def stored_stats(spark: SparkSession, path: str) -> DataFrame:
    """The same of the newest rows of a stored memo; of each row only its key and size are shuffled."""
    sizes = stored_rows(spark, path).select("cache_key", "seq", _octets())
    return _totals(sizes.groupBy("cache_key").agg(F.max_by("octets", "seq").alias("octets")))


def _totals(sizes: DataFrame) -> DataFrame:
    return sizes.agg(
        F.count("*").alias("entries"),
        F.round(F.coalesce(F.sum("octets"), F.lit(0)) / (1024 * 1024), 2).alias("size_mb"),
    )


def hits(sources: DataFrame, memo: DataFrame) -> DataFrame:
    """Batch lookup of (cache_key, text, ord): texts that share a key give one hit, for the last."""
    asked = sources.groupBy("cache_key").agg(F.max_by("text", "ord").alias("text"))
    return asked.join(memo.select("cache_key", "translated_text"), "cache_key").select(
        "text", F.col("translated_text").alias("translated")
    )


def misses(sources: DataFrame, memo: DataFrame) -> DataFrame:
    """Sources whose key has no finished work yet."""
    return sources.join(memo.select("cache_key"), "cache_key", "left_anti")


def distinct_work(segments: DataFrame, order: list[str]) -> DataFrame:
    """One owner row per key with its number of copies ``n``; copies meet pre-aggregated."""
    rest = [c for c in segments.columns if c != "cache_key"]
    return segments.groupBy("cache_key").agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"), F.count("*").alias("n")
    ).select("cache_key", "n", "_row.*")


def spread_results(segments: DataFrame, results: DataFrame, order: list[str]) -> DataFrame:
    """Give every copy its result; keys with very many copies are salted. ``segments`` (a table) is read three times."""
    counts = segments.groupBy("cache_key").agg(F.count("*").alias("n"))
    heavy = heavy_keys(counts, "cache_key", total=segments.agg(F.count("*").alias("_all")))
    return join_unique(segments, results, "cache_key", heavy, order)


def unexpired(rows: DataFrame, now: Column, ttl_seconds: Column) -> DataFrame:
    """Rows within their time to live; a NULL ttl never expires."""
    age = F.unix_micros(now) - F.unix_micros("created_at")
    return rows.where(ttl_seconds.isNull() | (age <= ttl_seconds.cast("bigint") * 1_000_000))


def evict_oldest_half(rows: DataFrame, full: int = K.LRU_FULL) -> DataFrame:
    """Above ``full`` entries the half with the oldest access goes, else nothing.

    Ranks come from minute blocks, so no sort of the whole table meets in one
    task; the step over blocks sees one row per minute of access times.
    """
    total = rows.agg(F.count("*").alias("_all"))  # one row
    timed = rows.withColumn("_one", F.lit(1)).withColumn("_at", F.unix_micros("last_access"))
    blocks = blocked.with_block(timed, F.col("_at"), 60_000_000)
    ranked = blocked.row_number(blocks, ["_one"], ["_at", "cache_key"], "_rank")
    kept = (F.col("_all") <= full) | (F.col("_rank") > F.floor(F.col("_all") / 2))
    return (
        ranked.join(F.broadcast(total)).where(kept)
        .drop("_one", "_at", "_rank", "_all", blocked.BLOCK)
    )


def newest(rows: DataFrame, limit: int, *order: Column) -> DataFrame:
    """Top rows by an order; Spark keeps ``limit`` rows per partition before they meet."""
    return rows.orderBy(*order).limit(limit)


def recent_files(opened: DataFrame, limit: int = K.RECENT_FILES) -> DataFrame:
    """The last opened distinct files, newest first."""
    last = opened.groupBy("file").agg(F.max("at").alias("at"))
    return newest(last, limit, F.desc("at"), F.asc("file"))


def log_tail(lines: DataFrame, key: str, limit: int = K.LOG_TAIL_LINES) -> DataFrame:
    """The last lines of every log; the rank filter limits rows before the shuffle."""
    order = Window.partitionBy(key).orderBy(F.desc("line_no"))
    return lines.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")
