"""Layout aggregates and line grouping over spans and lines of pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow import constants as K
from folioflow.functions import geometry as G
from folioflow.operators import blocked
from folioflow.operators.skew import heavy_keys, join_unique


def mode_first_seen(rows: DataFrame, keys: Sequence[str], value: str, order: Column,
                    out: str) -> DataFrame:
    """Most frequent value per key; ties go to the value seen first."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    # the order is compared in reverse: keep the smallest first position
    best = counts.groupBy(*keys).agg(F.max("_n").alias("_n"))
    return (
        counts.join(best, [*keys, "_n"])
        .groupBy(*keys)
        .agg(F.min_by(value, "_first").alias(out))
    )


def majority(vote: Column) -> Column:
    """Aggregate: more than half of the votes are true."""
    return F.count_if(vote) > F.count("*") / 2


def upper_median(rows: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Element n/2 (0-based) of the sorted values, from value counts.

    ``value`` is expected on a coarse grid (sizes rounded to a tenth), so a
    group of any size has few distinct values.
    """
    from pyspark.sql import Window

    order = Window.partitionBy(*keys).orderBy(value)
    everything = Window.partitionBy(*keys)
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return (
        counts.withColumn("_upto", F.sum("_n").over(order))
        .withColumn("_all", F.sum("_n").over(everything))
        .where(F.col("_upto") > F.floor(F.col("_all") / 2))
        .groupBy(*keys)
        .agg(F.min(value).alias(out))
    )


def size_outliers(rows: DataFrame, keys: Sequence[str], size: str) -> DataFrame:
    """Rows whose size is beyond the page's limit; the limit comes with them."""
    medians = upper_median(rows.withColumn("_size", F.round(size, 1)), keys, "_size", "median")
    limited = medians.withColumn(
        "size_limit",
        F.greatest(F.lit(K.OUTLIER_FONT_FLOOR), F.col("median") * K.OUTLIER_FONT_FACTOR),
    )
    return rows.join(limited, list(keys)).where(F.col(size) > F.col("size_limit"))


def block_shape(lines: DataFrame, keys: Sequence[str], recognised: bool = False) -> DataFrame:
    """Per block: box, spreads, vertical flag and whether it looks like a table.

    ``lines`` has box, text, vertical (by direction) and pos. For vertical
    blocks with several columns the first line's height range decides.
    """
    tolerance = K.TABLE_LIKE_X_TOLERANCE_OCR if recognised else K.TABLE_LIKE_X_TOLERANCE
    spread = {a: F.max(f"box.{a}0") - F.min(f"box.{a}0") for a in ("x", "y")}
    shape = lines.groupBy(*keys).agg(
        F.count("*").alias("lines"),
        G.union_all(F.col("box")).alias("bounds"),
        spread["x"].alias("x_spread"),
        spread["y"].alias("y_spread"),
        F.avg(F.length("text")).alias("mean_chars"),
        majority(F.col("vertical")).alias("by_direction"),
        F.min_by("box", "pos").alias("first_box"),
    )
    by_spread = (
        (F.col("lines") > 1)
        & (F.col("mean_chars") <= K.VERTICAL_MEAN_CHARS)
        & (F.col("y_spread") > F.col("x_spread") * K.VERTICAL_SPREAD_RATIO)
    )
    shape = shape.withColumn("block_vertical", F.col("by_direction") | by_spread)
    apart = (
        lines.join(shape.where("block_vertical").select(*keys, "first_box"), list(keys))
        .groupBy(*keys)
        .agg(F.bool_or(G.y_overlap(F.col("first_box"), F.col("box")) < K.TABLE_LIKE_Y_OVERLAP)
             .alias("_apart"))
    )
    return (
        shape.join(apart, list(keys), "left")
        .withColumn(
            "table_like",
            F.when(
                F.col("block_vertical"),
                (F.col("x_spread") > K.TABLE_LIKE_X_TOLERANCE) & F.col("_apart"),
            ).otherwise(F.col("x_spread") > tolerance),
        )
        .drop("_apart", "first_box")
    )


def split_by_size(lines: DataFrame, keys: Sequence[str], order: Sequence[str], size: str,
                  out: str = "line_group") -> DataFrame:
    """A new group where the size changes by more than the ratio; needs block numbers."""

    def jump(before: Column, here: Column) -> Column:
        ratio = F.greatest(here, before) / F.least(here, before)
        return (here > 0) & (before > 0) & (ratio > K.FONT_SPLIT_RATIO)

    return blocked.break_runs(lines, keys, order, F.col(size), jump, out)


def group_table_lines(lines: DataFrame, keys: Sequence[str], order: Sequence[str], box: Column,
                      size: Column, out: str = "line_group") -> DataFrame:
    """Neighbouring lines with a similar left edge and a small gap stay together."""

    def apart(before: Column, here: Column) -> Column:
        shift = F.abs(here["box"]["x0"] - before["box"]["x0"])
        drop = F.greatest(here["box"]["y0"] - before["box"]["y1"], F.lit(0.0))
        return (shift > K.TABLE_ROW_X_TOLERANCE) | (drop > before["size"] * K.TABLE_ROW_GAP_FACTOR)

    line = F.struct(box.alias("box"), size.alias("size"))
    return blocked.break_runs(lines, keys, order, line, apart, out)


def join_text(rows: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, sep: str,
              out: str = "text") -> DataFrame:
    """Ordered concatenation per group; the result is one text per group by definition."""
    pieces = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_text"))))
    return rows.groupBy(*keys).agg(
        F.array_join(F.transform(pieces, lambda p: p["_text"]), sep).alias(out)
    )


def text_reliability(spans: DataFrame, keys: Sequence[str], plausible: Column | None) -> DataFrame:
    """Share of trustworthy fragments per page; below the limit the page is unreliable.

    With a known language ``plausible`` decides; otherwise very short fragments
    count against the page.
    """
    from folioflow.functions.text import strip

    good = plausible if plausible is not None else (
        F.length(strip(F.col("text"))) > K.SHORT_FRAGMENT_CHARS
    )
    return spans.groupBy(*keys).agg(
        F.sum(F.length("text")).alias("chars"),
        F.avg(good.cast("int")).alias("reliability"),
    ).withColumn("unreliable", F.col("reliability") < K.RELIABLE_TEXT_SHARE)


def image_share(images: DataFrame, keys: Sequence[str], page_area: Column) -> DataFrame:
    """Part of each page covered by images, at most 1; 0 without a page area."""
    covered = F.sum(G.area(F.col("box")))
    return images.groupBy(*keys).agg(
        F.when(F.max(page_area) <= 0, F.lit(0.0))
        .otherwise(F.least(F.lit(1.0), covered / F.max(page_area)))
        .alias("image_share")
    )


def reliable_blocks(blocks: DataFrame) -> DataFrame:
    """Recognised blocks whose pass rate suffices: candidates, kept, table_like."""
    needed = F.when(F.col("candidates") <= 4, 0.5).otherwise(0.3)
    weak = (
        F.col("table_like") & (F.col("candidates") > 0)
        & (F.col("kept") / F.col("candidates") < needed)
    )
    return blocks.where(~F.coalesce(weak, F.lit(False)))


def best_result(results: DataFrame, keys: Sequence[str], text: Column, lang: Column,
                order: str) -> DataFrame:
    """Best recognition attempt per region by script score; the first wins ties."""
    from folioflow.functions.scripts import plausibility

    verdict = plausibility(text, lang)
    scored = results.where(text != "").withColumn("_v", verdict).withColumn(
        "score", F.when(F.col("_v.ok"), F.col("_v.ratio")).otherwise(F.col("_v.ratio") * 0.2)
    ).drop("_v")
    rest = [c for c in scored.columns if c not in keys]
    return scored.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(F.col("score"), (-F.col(order)).alias("_first"))).alias("_best")
    ).select(*keys, "_best.*")


def words_to_lines(words: DataFrame, keys: Sequence[str], dpi: float) -> DataFrame:
    """Recognised words to lines per (block, par, line), in points.

    The numbers are compared as integers, so block 10 follows block 2.
    """
    scale = 72.0 / dpi
    x0, y0 = F.col("left") * scale, F.col("top") * scale
    scaled = words.select(
        *keys, "block", "par", "line", "word", "text",
        G.box(x0, y0, x0 + F.col("width") * scale, y0 + F.col("height") * scale).alias("box"),
    )
    line = [*keys, "block", "par", "line"]
    pieces = F.array_sort(F.collect_list(F.struct("word", "text")))
    return scaled.groupBy(*line).agg(
        G.union_all(F.col("box")).alias("box"),
        F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("text"),
    ).withColumn("size", F.greatest(F.col("box.y1") - F.col("box.y0"), F.lit(1.0)))


def background_safety(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Is a region bright and even enough to write over? Adds mean, bright share and verdict.

    ``pixels`` has pos (0-based in the region), r, g, b. Every n-th pixel is
    looked at, so that a region gives about the sample size; this sampling is
    the rule itself.
    """
    sizes = pixels.groupBy(*keys).agg(
        F.greatest(F.lit(1), F.floor(F.count("*") / K.PIXEL_SAMPLES)).alias("_stride"),
        F.count("*").alias("n"),
    )
    heavy = heavy_keys(sizes.select(*keys, "n"), keys)
    strided = join_unique(pixels, sizes.drop("n"), keys, heavy, ["pos"], "inner")
    value = (F.col("r") + F.col("g") + F.col("b")) / 3
    seen = strided.where(F.col("pos") % F.col("_stride") == 0).groupBy(*keys).agg(
        F.count("*").alias("_n"), F.avg(value).alias("mean"),
        F.avg((value >= K.BRIGHT_PIXEL).cast("int")).alias("bright"),
    )
    enough = F.col("_n") >= K.PIXEL_MINIMUM
    safe = enough & (F.col("mean") >= K.SAFE_MEAN) & (F.col("bright") >= K.SAFE_BRIGHT_SHARE)
    return seen.select(
        *keys, "mean", F.when(enough, F.col("bright")).otherwise(0.0).alias("bright"), safe.alias("safe")
    )
