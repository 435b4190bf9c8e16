"""Page sets: collapse to ranges, set algebra, progress records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow import constants as K
from folioflow.functions.naming import RANGES
from folioflow.operators import blocked
from folioflow.session import materialize

PAGE_SPAN = 1 << 16
PART_RANGES = 4096
TAGS = ("scope", "target", "failed", "prior", "left")


def collapse(pages: DataFrame, keys: Sequence[str], page: str = "page",
             span: int = PAGE_SPAN) -> DataFrame:
    """Maximal runs of consecutive distinct pages per key: first, last.

    Islands are found inside page spans of a fixed width. Only the islands that
    touch a span border can continue in the next span, at most two per span, so
    only those meet in a window over the whole key.
    """
    keys = list(keys)
    distinct = pages.select(*keys, F.col(page).alias("page")).distinct()
    distinct = blocked.with_block(distinct, F.col("page"), span)
    inside = Window.partitionBy(*keys, blocked.BLOCK).orderBy("page")
    islands = (
        distinct.withColumn("_island", F.col("page") - F.row_number().over(inside))
        .groupBy(*keys, blocked.BLOCK, "_island")
        .agg(F.min("page").alias("first"), F.max("page").alias("last"))
    )
    on_border = (F.col("first") % span == 0) | (F.col("last") % span == span - 1)
    over_key = Window.partitionBy(*keys).orderBy("first")
    joined = (
        islands.where(on_border)
        .withColumn("_new", (F.col("first") != F.lag("last").over(over_key) + 1).cast("int"))
        .withColumn("_run", F.sum(F.coalesce("_new", F.lit(1))).over(over_key))
        .groupBy(*keys, "_run")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"))
    )
    columns = [*keys, "first", "last"]
    return islands.where(~on_border).select(*columns).unionByName(joined.select(*columns))


def expand(ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The pages of (first, last) rows."""
    return ranges.select(*keys, F.explode(F.sequence("first", "last")).alias("page"))


def range_outline(ranges: DataFrame, keys: Sequence[str], listed: int = K.LISTED_RANGES) -> DataFrame:
    """Per key a STRUCT<count, low, high, ranges> holding the first few ranges.

    The row-number filter becomes a limit before the shuffle, so a key with
    very many ranges never meets in one list. The ranges are read twice and
    written out once for it.
    """
    ranges = materialize(ranges, "ranges")
    order = Window.partitionBy(*keys).orderBy("first")
    first_few = (
        ranges.withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= listed)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("ranges"))
    )
    totals = ranges.groupBy(*keys).agg(
        F.count("*").alias("count"), F.min("first").alias("low"), F.max("last").alias("high")
    )
    return totals.join(first_few, list(keys)).select(
        *keys, F.struct("count", "low", "high", "ranges").alias("outline")
    )


def outlines_by_state(outlines: DataFrame, key: str) -> DataFrame:
    """One row per key with the outlines of its finished and unfinished pages."""
    def of(state: str) -> Column:
        return F.any_value(F.when(F.col("state") == state, F.col("outline")), True)

    return outlines.groupBy(key).agg(of("translated").alias("done"), of("untranslated").alias("rest"))


def empty_outline() -> Column:
    return F.struct(
        F.lit(0).cast("bigint").alias("count"), F.lit(0).alias("low"), F.lit(0).alias("high"),
        F.array().cast(RANGES).alias("ranges"),
    )


def page_sets(status: DataFrame, scope: DataFrame, key: str, prior_scope: DataFrame | None = None,
              prior_left: DataFrame | None = None) -> DataFrame:
    """Translated and untranslated pages after a run: key, page, state.

    ``status`` has one row per target segment (page, failed) and ``scope`` the
    pages the job covers; earlier runs give the pages they covered and those
    they left. A page is translated when an earlier run finished it, or when
    this run had targets on it and none failed. All inputs are tagged and meet
    in one aggregation, so the set algebra costs a single shuffle.
    """
    def tagged(df: DataFrame, **flags: Column) -> DataFrame:
        return df.select(
            key, "page", *[flags.get(t, F.lit(False)).alias(t) for t in TAGS]
        )

    yes = F.lit(True)
    rows = tagged(scope, scope=yes).unionByName(tagged(status, target=yes, failed=F.col("failed")))
    if prior_scope is not None:
        rows = rows.unionByName(tagged(prior_scope, prior=yes))
    if prior_left is not None:
        rows = rows.unionByName(tagged(prior_left, left=yes))
    return tagged_page_sets(rows, key)


def tagged_page_sets(rows: DataFrame, key: str) -> DataFrame:
    """The same of rows that say themselves what they are: key, page and the booleans scope, target, failed, prior, left.

    Where all inputs come from one frame it is passed once, not once per input.
    """
    pages = rows.groupBy(key, "page").agg(*[F.bool_or(t).alias(t) for t in TAGS])
    done = (F.col("prior") & ~F.col("left")) | (F.col("target") & ~F.col("failed"))
    return pages.where(done | F.col("scope")).select(
        key, "page", F.when(done, "translated").otherwise("untranslated").alias("state")
    )


def sidecar_parts(ranges: DataFrame, key: str, part: int = PART_RANGES) -> DataFrame:
    """Ranges of both states in numbered parts of bounded length: key, part, t_ranges, u_ranges.

    ``ranges`` has key, state, first and last.
    """
    cut = blocked.with_block(ranges, F.col("first"))
    cut = blocked.row_number(cut, [key, "state"], ["first"], "_n")

    def of(state: str) -> Column:
        spans = F.collect_list(F.when(F.col("state") == state, F.array("first", "last")))
        return F.array_sort(spans)

    return (
        cut.withColumn("part", F.floor((F.col("_n") - 1) / part).cast("int"))
        .groupBy(key, "part")
        .agg(of("translated").alias("t_ranges"), of("untranslated").alias("u_ranges"))
    )


def run_progress(batches: DataFrame, key: str) -> DataFrame:
    """Progress after every batch: key, batch_id, batches, pages, all_pages, percent.

    ``batches`` has (key, batch_id, page) rows. A page counts in the batch that
    sees it first, so the running distinct count is a running sum.
    """
    seen = batches.groupBy(key, "page").agg(F.min("batch_id").alias("batch_id"))
    fresh = seen.groupBy(key, "batch_id").agg(F.count("*").alias("_fresh"))
    ids = batches.select(key, "batch_id").distinct()
    per_batch = blocked.with_block(
        ids.join(fresh, [key, "batch_id"], "left").na.fill(0, ["_fresh"]), F.col("batch_id")
    )
    running = blocked.running_sum(
        per_batch, [key], ["batch_id"], F.col("_fresh"), "pages",
        totals={"batches": F.count("*"), "all_pages": F.sum("_fresh")},
    )
    return running.select(
        key, "batch_id", "batches", "pages", "all_pages",
        (F.lit(100.0) * (F.col("batch_id") + 1) / F.col("batches")).alias("percent"),
    )
