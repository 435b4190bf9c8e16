"""Neighbour joins on boxes of a page.

Every join meets in grid cells: a box is listed in the cells it reaches, and a
pair is kept only in the one cell that holds the lower corner of the two cell
ranges' intersection. So a pair appears once without a distinct, and a page of
any size is spread over its cells. Equal boxes are folded into one row with a
count before they meet, so a heap of copies costs one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow import constants as K
from folioflow.functions import geometry as G
from folioflow.operators.skew import heavy_keys, join_unique

CELL = 64.0
#: Side of a cell where boxes are widened far, as a multiple of the reach: a box then lies in few cells, not in dozens.
REACH_SHARE = 2.0


def fold_copies(boxes: DataFrame, keys: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Distinct boxes per page with their number of copies ``n``."""
    return boxes.groupBy(*keys, "box", *extra).agg(F.count("*").alias("n"))


def _with_copies(boxes: DataFrame, folded: DataFrame, facts: DataFrame, keys: Sequence[str],
                 how: str) -> DataFrame:
    """Bring facts about distinct boxes back to all copies; heaps of copies are salted."""
    on = [*keys, "box"]
    rest = [c for c in boxes.columns if c not in on] or on
    return join_unique(boxes, facts, on, heavy_keys(folded, on), rest, how)


def _cell_range(box: Column, reach: tuple, cell: float) -> tuple[Column, Column, Column, Column]:
    left, up, right, down = reach
    return (F.floor((box["x0"] - left) / cell), F.floor((box["x1"] + right) / cell),
            F.floor((box["y0"] - up) / cell), F.floor((box["y1"] + down) / cell))


def _cells(df: DataFrame, box: Column, reach: tuple, cell: float) -> DataFrame:
    x0, x1, y0, y1 = _cell_range(box, reach, cell)
    return (
        df.withColumn("_cx", F.explode(F.sequence(x0, x1)))
        .withColumn("_cy", F.explode(F.sequence(y0, y1)))
    )


def near_pairs(a: DataFrame, b: DataFrame, keys: Sequence[str], on: Column,
               reach: tuple = (0.0, 0.0, 0.0, 0.0), how: str = "inner",
               cell: float = CELL) -> DataFrame:
    """Pairs of rows of ``a`` and ``b`` (columns prefixed a_ and b_) that satisfy ``on``.

    ``a`` has ``a_box`` and ``b`` has ``b_box``; the widened a-box must touch
    the b-box wherever ``on`` can hold.
    """
    none = (0.0, 0.0, 0.0, 0.0)
    left = _cells(a, F.col("a_box"), reach, cell)
    right = _cells(b, F.col("b_box"), none, cell)
    # the lower corners follow from the boxes, so no row carries them through the shuffle
    ax, _, ay, _ = _cell_range(F.col("a_box"), reach, cell)
    bx, _, by, _ = _cell_range(F.col("b_box"), none, cell)
    home = (F.col("_cx") == F.greatest(ax, bx)) & (F.col("_cy") == F.greatest(ay, by))
    pairs = left.join(right, [*keys, "_cx", "_cy"]).where(home & on)
    return pairs.drop("_cx", "_cy")


def prefixed(boxes: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    return boxes.select(
        *keys, *[F.col(c).alias(f"{prefix}_{c}") for c in boxes.columns if c not in keys]
    )


def mergeable_pairs(pieces: DataFrame, keys: Sequence[str], order: str = "id") -> DataFrame:
    """Pairs (a before b) of vertical pieces that may belong to one sentence, with their gap.

    ``pieces`` has id, box, size, text, vertical. The reach is the largest gap
    the merge rule allows for the larger font of a pair; as the fonts of a pair
    differ by a small ratio at most, the own font bounds it.
    """
    own = F.greatest(F.col("a_size"), F.lit(1.0)) * K.MERGE_FONT_RATIO
    a, b = prefixed(pieces, keys, "a"), prefixed(pieces, keys, "b")

    def piece(p: str) -> dict:
        return {n: F.col(f"{p}_{n}") for n in ("box", "size", "text")}

    rule = (
        (F.col(f"a_{order}") < F.col(f"b_{order}"))
        & (F.col("a_vertical") | F.col("b_vertical"))
        & G.can_merge_columns(piece("a"), piece("b"))
    )
    wide, high = own * K.COLUMN_SIDE_GAP, own * K.COLUMN_STACK_GAP
    pairs = near_pairs(a, b, keys, rule, (wide, high, wide, high))
    gap = G.x_gap(F.col("a_box"), F.col("b_box")) + G.y_gap(F.col("a_box"), F.col("b_box"))
    return pairs.withColumn("gap", gap)


def free_boxes(boxes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Boxes that overlap no other box of their page (anti-join on overlap)."""
    folded = fold_copies(boxes, keys)
    a, b = prefixed(folded, keys, "a"), prefixed(folded, keys, "b")
    hit = near_pairs(
        a, b, keys,
        (F.col("a_box") != F.col("b_box")) & (G.overlap_area(F.col("a_box"), F.col("b_box")) > 0),
    ).select(*keys, F.col("a_box").alias("box"))
    own_copies = folded.where((F.col("n") > 1) & (G.area(F.col("box")) > 0)).select(*keys, "box")
    blocked = hit.unionByName(own_copies).distinct()
    return _with_copies(boxes, folded, blocked, keys, "left_anti")


def free_room(boxes: DataFrame, keys: Sequence[str], page_box: Column,
              pad: float = K.ROOM_PAD, growth: float = K.ROOM_GROWTH) -> DataFrame:
    """Grow every box into the free space around it: adds ``room``.

    Growth is limited (one unit sideways, half up, one and a half down), so only
    obstacles within that distance matter and the join stays local.
    """
    up, down = growth * 0.5, growth * 1.5
    folded = fold_copies(boxes, keys)
    a = prefixed(folded.drop("n"), keys, "a")
    b = prefixed(folded.drop("n"), keys, "b")
    cell = max(CELL, REACH_SHARE * (growth + pad), REACH_SHARE * (max(up, down) + pad))
    me, other = F.col("a_box"), F.col("b_box")
    pairs = near_pairs(a, b, keys, me != other, (growth + pad, up + pad, growth + pad, down + pad), cell=cell)
    beside = (other["y1"] > me["y0"]) & (other["y0"] < me["y1"])
    stacked = (other["x1"] > me["x0"]) & (other["x0"] < me["x1"])
    limits = pairs.groupBy(*keys, "a_box").agg(
        F.max(F.when(beside & (other["x1"] <= me["x0"]), other["x1"])).alias("_l"),
        F.min(F.when(beside & (other["x0"] >= me["x1"]), other["x0"])).alias("_r"),
        F.max(F.when(stacked & (other["y1"] <= me["y0"]), other["y1"])).alias("_t"),
        F.min(F.when(stacked & (other["y0"] >= me["y1"]), other["y0"])).alias("_b"),
    ).withColumnRenamed("a_box", "box")
    box = F.col("box")
    room = G.box(
        F.least(F.greatest(F.greatest("_l", page_box["x0"]) + pad, box["x0"] - growth), box["x0"]),
        F.least(F.greatest(F.greatest("_t", page_box["y0"]) + pad, box["y0"] - up), box["y0"]),
        F.greatest(F.least(F.least("_r", page_box["x1"]) - pad, box["x1"] + growth), box["x1"]),
        F.greatest(F.least(F.least("_b", page_box["y1"]) - pad, box["y1"] + down), box["y1"]),
    )
    return (
        _with_copies(boxes, folded, limits, keys, "left").withColumn("room", room)
        .drop("_l", "_r", "_t", "_b")
    )


def covered_images(images: DataFrame, segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Small images that a segment covers for the larger part."""
    folded = fold_copies(images, keys)
    a = prefixed(folded, keys, "a")
    b = prefixed(fold_copies(segments, keys), keys, "b")
    image, segment = F.col("a_box"), F.col("b_box")
    floor = F.lit(1e-6)
    image_area = F.greatest(G.area(image), floor)
    covered = (
        (G.overlap_area(image, segment) / image_area > K.IMAGE_COVERED_SHARE)
        & (image_area <= F.greatest(G.area(segment), floor) * K.IMAGE_MAX_SHARE)
    )
    found = near_pairs(a, b, keys, covered).select(*keys, image.alias("box")).distinct()
    return _with_copies(images, folded, found, keys, "left_semi")
