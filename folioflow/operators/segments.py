"""The segment scan: text rows to ordered segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow import constants as K
from folioflow.functions.text import has_letter, segment_lines
from folioflow.operators import blocked


def segment_id(page: Column, block: Column) -> Column:
    """Identifier with 1-based page and 0-based block."""
    return F.format_string(K.SEGMENT_ID_FORMAT, page + 1, block)


def scan(documents: DataFrame, key: str = "doc_id", text: str = "text",
         translate_all: bool = False, page_filter: Column | None = None,
         keep: Sequence[str] = ()) -> DataFrame:
    """One row per non-blank line: key, pos, page, block, seg_id, text, needs and ``keep``.

    All positions come out of the row that is exploded, so the scan never
    shuffles. ``page_filter`` is a predicate on ``page`` and is applied before
    the remaining columns are built.
    """
    lines = documents.select(
        key, *keep, F.posexplode(segment_lines(F.col(text))).alias("pos", "text")
    )
    lines = lines.withColumn("page", F.floor(F.col("pos") / K.LINES_PER_PAGE).cast("int"))
    if page_filter is not None:
        lines = lines.where(page_filter)
    needs = F.lit(True) if translate_all else has_letter(F.col("text"))
    return lines.withColumn("block", F.col("pos") % K.LINES_PER_PAGE).select(
        key, "pos", "page", "block",
        segment_id(F.col("page"), F.col("block")).alias("seg_id"),
        "text", needs.alias("needs"), *keep,
    )


def number_blocks(rows: DataFrame, page_keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Number the kept segments of each page from 0; ``rows`` carries block numbers."""
    numbered = blocked.row_number(rows, page_keys, order, "block")
    return numbered.withColumn("block", (F.col("block") - 1).cast("int"))


def page_clip(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """Semi-join segments or pages with a page selection on all shared columns."""
    shared = [c for c in pages.columns if c in spans.columns]
    return spans.join(pages.select(*shared).distinct(), shared, "left_semi")


def run_summary(segments: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts of segments, targets, skipped ones and target characters."""
    needs = F.col("needs")
    return segments.groupBy(*keys).agg(
        F.count("*").alias("segments"),
        F.count_if(needs).alias("targets"),
        F.count_if(~needs).alias("skipped"),
        F.coalesce(F.sum(F.when(needs, F.length("text"))), F.lit(0)).alias("target_chars"),
    )
