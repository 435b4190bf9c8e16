"""Box arithmetic. A box is a STRUCT<x0, y0, x1, y1: DOUBLE>."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow import constants as K
from folioflow.functions.arrow import arrow_batched


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(
        x0.cast("double").alias("x0"), y0.cast("double").alias("y0"),
        x1.cast("double").alias("x1"), y1.cast("double").alias("y1"),
    )


def _gap(a: Column, b: Column, lo: str, hi: str) -> Column:
    return F.greatest(b[lo] - a[hi], a[lo] - b[hi], F.lit(0.0))


def x_gap(a: Column, b: Column) -> Column:
    """Horizontal distance; 0 when the boxes share an x."""
    return _gap(a, b, "x0", "x1")


def y_gap(a: Column, b: Column) -> Column:
    return _gap(a, b, "y0", "y1")


def _shared(a: Column, b: Column, lo: str, hi: str) -> Column:
    return F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo])


def y_overlap(a: Column, b: Column) -> Column:
    """Shared height as a part of the lower box."""
    shared = _shared(a, b, "y0", "y1")
    lower = F.least(a["y1"] - a["y0"], b["y1"] - b["y0"])
    return F.when(shared <= 0, F.lit(0.0)).otherwise(shared / F.greatest(lower, F.lit(1e-6)))


def overlap_area(a: Column, b: Column) -> Column:
    w, h = _shared(a, b, "x0", "x1"), _shared(a, b, "y0", "y1")
    return F.when((w <= 0) | (h <= 0), F.lit(0.0)).otherwise(w * h)


def area(b: Column) -> Column:
    return F.greatest(b["x1"] - b["x0"], F.lit(0.0)) * F.greatest(b["y1"] - b["y0"], F.lit(0.0))


def union(a: Column, b: Column) -> Column:
    return box(
        F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]),
        F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]),
    )


def union_all(b: Column) -> Column:
    """Aggregate: the smallest box around a group."""
    return box(F.min(b["x0"]), F.min(b["y0"]), F.max(b["x1"]), F.max(b["y1"]))


def is_vertical_direction(dx: Column, dy: Column) -> Column:
    return F.abs(dy) > F.abs(dx)


def is_vertical_layout(lines: Column, x_spread: Column, y_spread: Column, region: Column) -> Column:
    """Vertical by the spread of two or more line starts, else by the region's shape."""
    by_shape = (region["y1"] - region["y0"]) > (region["x1"] - region["x0"]) * K.VERTICAL_BOX_RATIO
    by_spread = y_spread > x_spread * K.VERTICAL_LINE_SPREAD_RATIO
    return F.when((lines >= 2) & ((x_spread > 0) | (y_spread > 0)), by_spread).otherwise(by_shape)


def hex_color(rgb: Column) -> Column:
    return F.concat(F.lit("#"), F.lower(F.lpad(F.hex(rgb), 6, "0")))


def color_parts(hexed: Column) -> Column:
    """STRUCT<r, g, b> in 0..1 of ``#rrggbb``."""
    digits = F.regexp_replace(hexed, r"\A#+", "")

    def part(at: int) -> Column:
        return F.conv(F.substring(digits, at, 2), 16, 10).cast("int") / 255.0

    return F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b"))


def can_merge_columns(a: Column, b: Column) -> Column:
    """May two pieces (STRUCT<box, size, text>) of vertical text belong to one sentence?"""
    from folioflow.functions.text import ends_sentence, strip

    large = F.greatest(a["size"], b["size"], F.lit(1.0))
    small = F.greatest(F.least(a["size"], b["size"]), F.lit(0.1))
    gap = x_gap(a["box"], b["box"])
    stacked = gap <= large * K.SAME_COLUMN_GAP
    a_first = F.when(stacked, a["box"]["y0"] <= b["box"]["y0"]).otherwise(
        a["box"]["x0"] >= b["box"]["x0"]
    )
    first_text = F.when(a_first, a["text"]).otherwise(b["text"])
    near = F.when(stacked, y_gap(a["box"], b["box"]) <= large * K.COLUMN_STACK_GAP).otherwise(
        (gap <= large * K.COLUMN_SIDE_GAP) & (y_overlap(a["box"], b["box"]) > K.COLUMN_OVERLAP)
    )
    return (large / small <= K.MERGE_FONT_RATIO) & ~ends_sentence(strip(first_text)) & near


def spread_words(text: str, widths: list[float]) -> str:
    """Lay the words of a text over lines in proportion to the lines' widths."""
    text = " ".join(p for p in text.replace("\r", "").replace("\t", " ").split(" ") if p).strip()
    if not text or len(widths) < 2:
        return text
    wide = [max(1.0, w) for w in widths]
    rest, lines = text.split(" "), []
    for w in wide[:-1]:
        if not rest:
            break
        room = max(1, round(len(text) * w / sum(wide)))
        taken, used = 1, len(rest[0])
        while used < room and taken < len(rest) and used + 1 + len(rest[taken]) <= room:
            used += 1 + len(rest[taken])
            taken += 1
        lines.append(" ".join(rest[:taken]))
        rest = rest[taken:]
    if rest:
        lines.append(" ".join(rest))
    return "\n".join(line for line in lines if line)


@arrow_batched("string")
def fit_to_lines(texts: pd.Series, widths: pd.Series) -> pd.Series:
    return pd.Series([spread_words(t or "", [w for w in ws if w > 0]) for t, ws in zip(texts, widths)])
