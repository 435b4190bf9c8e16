"""Segments from the spans of a page, decided inside the row.

A page is one row with its blocks of lines of spans. Every decision (which text
layer counts, vertical or not, table-like or not, where a block is cut, which
segments stay) only looks at the page, so all of it is nested array expressions:
no exchange, and a page with many spans costs time in proportion to them.

The two layers of a page, the embedded text and what recognition found, have the
type ``BLOCKS``. The recognised layer replaces the text where that is too short or
not to be trusted; its segments have to pass the script and font-size checks, and
table-like blocks of which too little passes go as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow import constants as K
from folioflow.functions import geometry as G
from folioflow.functions import scripts
from folioflow.functions.binding import let
from folioflow.functions.text import clean_characters, has_letter, strip
from folioflow.operators.segments import segment_id

BOX = "struct<x0: double, y0: double, x1: double, y1: double>"
SPAN = "struct<text: string, size: double, color: int, flags: int, font: string>"
LINE = f"struct<spans: array<{SPAN}>, box: {BOX}, dx: double, dy: double>"
BLOCKS = f"array<struct<box: {BOX}, lines: array<{LINE}>>>"


def _all(values: Column, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(values, test))


def _total(values: Column, value: Callable[[Column], Column]) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + value(x))


_ODD = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{2022}\x{e000}-\x{f8ff}\x{fffd}]"


def _cleaned(text: Column) -> Column:
    """``clean_characters``, with cheap looks first at whether a text holds anything that it would change."""
    def edge(c: Column) -> Column:
        return c.rlike(K.SPACE)

    def clean(t: Column) -> Column:
        touched = (t.contains("-") | t.contains("  ") | t.contains("\t") | t.rlike(_ODD)
                   | edge(F.substring(t, 1, 1)) | edge(F.substring(t, -1, 1)))
        return F.when(touched, clean_characters(t)).otherwise(t)

    return let(text, clean)


def _chars(texts: Column) -> Column:
    return _total(texts, F.length)


def _spread(values: Column) -> Column:
    return F.array_max(values) - F.array_min(values)


def mode_of(values: Column, default: Column) -> Column:
    """Most frequent element; ties go to the one seen first."""
    def ranked(vs: Column, distinct: Column) -> Column:
        return F.array_max(F.transform(distinct, lambda d, i: F.struct(
            _all(vs, lambda v: v == d).alias("n"), (-i).alias("first"), d.alias("value"))))["value"]

    return let(values, lambda vs: F.when(F.size(vs) == 0, default).otherwise(ranked(vs, F.array_distinct(vs))))


def upper_median_of(values: Column) -> Column:
    """Element n/2 (0-based) of the sorted values."""
    return let(F.sort_array(values), lambda vs: F.get(vs, F.floor(F.size(vs) / 2).cast("int")))


def _whole(blocks: Column) -> Column:
    """The layer without null blocks, lines and spans; null stays null."""
    def some(values: Column, kind: str) -> Column:
        return F.filter(F.coalesce(values, F.array().cast(f"array<{kind}>")), lambda x: x.isNotNull())

    def line(ln: Column) -> Column:
        return F.struct(some(ln["spans"], SPAN).alias("spans"), ln["box"].alias("box"), ln["dx"].alias("dx"), ln["dy"].alias("dy"))

    return F.transform(F.filter(blocks.cast(BLOCKS), lambda b: b.isNotNull()), lambda b: F.struct(
        b["box"].alias("box"), F.transform(some(b["lines"], LINE), line).alias("lines")))


def fragments(blocks: Column) -> Column:
    """All span texts of a layer."""
    return F.flatten(F.transform(blocks, lambda b: F.flatten(F.transform(
        b["lines"], lambda ln: F.transform(ln["spans"], lambda s: F.coalesce(s["text"], F.lit("")))))))


def _size(span: Column) -> Column:
    return F.round(F.coalesce(span["size"], F.lit(K.DEFAULT_FONT_SIZE)), 1)


def page_lines(block: Column) -> Column:
    """The non-blank lines of a block: text, box, sizes, colors, bold votes, vertical."""
    def line(ln: Column) -> Column:
        spans = ln["spans"]
        text = F.array_join(F.transform(spans, lambda s: F.coalesce(s["text"], F.lit(""))), "")
        bold = F.transform(spans, lambda s: (F.coalesce(s["flags"], F.lit(0)).bitwiseAND(K.BOLD_FLAG) != 0)
                           | F.coalesce(s["font"], F.lit("")).rlike("(?i)bold"))
        return F.struct(
            _cleaned(text).alias("text"), F.coalesce(ln["box"], block["box"]).alias("box"),
            F.transform(spans, _size).alias("sizes"), F.transform(spans, lambda s: F.coalesce(s["color"], F.lit(0))).alias("colors"),
            bold.alias("bold"), F.coalesce(G.is_vertical_direction(ln["dx"], ln["dy"]), F.lit(False)).alias("vertical"))

    return F.filter(F.transform(block["lines"], line), lambda ln: ln["text"] != "")


def block_shape(lines: Column, recognised: Column) -> Column:
    """STRUCT<vertical, table> of a block."""
    x_spread = _spread(F.transform(lines, lambda ln: ln["box"]["x0"]))
    y_spread = _spread(F.transform(lines, lambda ln: ln["box"]["y0"]))
    by_direction = _all(lines, lambda ln: ln["vertical"]) > F.size(lines) / 2
    short = _total(lines, lambda ln: F.length(ln["text"])) / F.greatest(F.size(lines), F.lit(1)) <= K.VERTICAL_MEAN_CHARS

    def shape(facts: Column) -> Column:
        by_spread = facts["many"] & facts["short"] & (facts["y"] > facts["x"] * K.VERTICAL_SPREAD_RATIO)
        vertical = facts["turned"] | by_spread
        apart = F.exists(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))),
                         lambda ln: G.y_overlap(lines[0]["box"], ln["box"]) < K.TABLE_LIKE_Y_OVERLAP)
        wide = F.when(recognised, K.TABLE_LIKE_X_TOLERANCE_OCR).otherwise(K.TABLE_LIKE_X_TOLERANCE)
        table = F.when(vertical, (facts["x"] > K.TABLE_LIKE_X_TOLERANCE) & apart).otherwise(facts["x"] > wide)
        return F.struct(vertical.alias("vertical"), table.alias("table"))

    return let(F.struct(x_spread.alias("x"), y_spread.alias("y"), by_direction.alias("turned"), short.alias("short"),
                        (F.size(lines) > 1).alias("many")), shape)


def _first_size(line: Column) -> Column:
    return F.coalesce(F.get(line["sizes"], F.lit(0)), F.lit(K.DEFAULT_FONT_SIZE))


def line_groups(lines: Column, table: Column) -> Column:
    """The lines cut into groups: where the font size jumps, or in tables where the row or the gap changes."""
    count = F.size(lines)

    def size_jump(before: Column, here: Column) -> Column:
        a, b = _first_size(before), _first_size(here)
        return (a > 0) & (b > 0) & (F.greatest(a, b) / F.least(a, b) > K.FONT_SPLIT_RATIO)

    def row_change(before: Column, here: Column) -> Column:
        shift = F.abs(here["box"]["x0"] - before["box"]["x0"])
        drop = F.greatest(here["box"]["y0"] - before["box"]["y1"], F.lit(0.0))
        return (shift > K.TABLE_ROW_X_TOLERANCE) | (drop > _first_size(before) * K.TABLE_ROW_GAP_FACTOR)

    def opens(i: Column) -> Column:
        before, here = F.get(lines, i - 1), F.get(lines, i)
        return (count > 0) & ((i == 0) | F.when(table, row_change(before, here)).otherwise(size_jump(before, here)))

    starts = F.filter(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), opens)
    return let(starts, lambda s: F.transform(s, lambda start, n: F.slice(
        lines, start + 1, F.coalesce(F.get(s, n + 1), count) - start)))


def _segment(group: Column, shape: Column, recognised: Column, lang: Column, rule: Column, limit: Column, translate_all: bool) -> Column:
    """A segment of one group, with ``ok``: does it stay?"""
    def flat(field: str) -> Column:
        return F.flatten(F.transform(group, lambda ln: ln[field]))

    def edge(pick: Callable, c: str) -> Column:
        return pick(F.transform(group, lambda ln: ln["box"][c]))

    box = G.box(edge(F.array_min, "x0"), edge(F.array_min, "y0"), edge(F.array_max, "x1"), edge(F.array_max, "y1"))
    joined = _cleaned(F.array_join(F.transform(group, lambda ln: ln["text"]), "\n"))
    text = let(joined, lambda t: F.when(recognised, scripts.sanitize_recognised(t, lang)).otherwise(t))
    size = mode_of(flat("sizes"), F.lit(K.DEFAULT_FONT_SIZE))
    color = mode_of(flat("colors"), F.lit(0))
    bold = let(flat("bold"), lambda v: _all(v, lambda b: b) > F.size(v) / 2)

    def built(f: Column) -> Column:
        passes = scripts.follows(f["text"], rule) & (f["size"] <= limit)
        return F.struct(
            f["text"].alias("text"), box.alias("box"), f["size"].alias("font_size"), G.hex_color(color).alias("color"),
            bold.alias("bold"), F.when(shape["table"], group[0]["vertical"]).otherwise(shape["vertical"]).alias("vertical"),
            shape["table"].alias("table_like"), recognised.alias("recognised"),
            (F.lit(True) if translate_all else has_letter(f["text"])).alias("needs"),
            F.transform(group, lambda ln: ln["box"]).alias("line_boxes"),
            ((f["text"] != "") & (~recognised | passes)).alias("ok"))

    return let(F.struct(text.alias("text"), size.alias("size")), built)


def _segments_of(block: Column, recognised: Column, lang: Column, rule: Column, limit: Column, translate_all: bool) -> Column:
    """The segments of a block that stay, each with ``culled``: does the block go as a whole?"""
    def made(lines: Column) -> Column:
        def shaped(shape: Column) -> Column:
            groups = line_groups(lines, shape["table"])
            segs = F.filter(F.transform(groups, lambda g: _segment(g, shape, recognised, lang, rule, limit, translate_all)), lambda s: s["ok"])
            asked = F.size(block["lines"])
            needed = F.when(asked <= 4, 0.5).otherwise(0.3)
            return let(segs, lambda ss: F.transform(ss, lambda s: F.struct(
                s.alias("segment"), F.coalesce(
                    recognised & shape["table"] & (F.size(ss) / asked < needed), F.lit(False)).alias("culled"))))

        return let(block_shape(lines, recognised), shaped)

    return let(page_lines(block), made)


def choose_layer(text_layer: Column, found_layer: Column, has_images: Column, image_share: Column, lang: Column,
                 rule: Column) -> Column:
    """STRUCT<blocks, recognised>: the layer that a page's segments come from.

    The text layer is in doubt below 20 characters, or where images cover more than
    half of the page and most fragments are implausible (without a language: very
    short). Without a known language a doubtful text is dropped, not replaced.
    """
    empty = F.array().cast(BLOCKS)

    def decide(f: Column) -> Column:
        good = F.when(lang.isNotNull(), _all(f["texts"], lambda t: scripts.follows(t, rule))).otherwise(
            _all(f["texts"], lambda t: F.length(strip(t)) > K.SHORT_FRAGMENT_CHARS))
        checked = (f["chars"] >= K.LEAST_PAGE_CHARS) & (F.coalesce(image_share, F.lit(0.0)) > K.IMAGE_PAGE_SHARE)
        bad = checked & (good / F.greatest(F.size(f["texts"]), F.lit(1)) < K.RELIABLE_TEXT_SHARE)

        def chosen(unreliable: Column) -> Column:
            doubt = ((f["chars"] < K.LEAST_PAGE_CHARS) | unreliable) & F.coalesce(has_images, F.lit(False))
            take = doubt & lang.isNotNull() & found_layer.isNotNull() & (unreliable | (_chars(fragments(found_layer)) > f["chars"]))
            drop = doubt & lang.isNull() & unreliable
            blocks = F.when(take, found_layer).when(drop, empty).otherwise(F.coalesce(text_layer, empty))
            return F.struct(blocks.alias("blocks"), take.alias("recognised"))

        return let(F.coalesce(bad, F.lit(False)), chosen)

    texts = F.coalesce(fragments(text_layer), F.array().cast("array<string>"))
    return let(texts, lambda ts: let(F.struct(ts.alias("texts"), _chars(ts).alias("chars")), decide))


def scan_spans(pages: DataFrame, keys: Sequence[str] = ("doc_id",), page: str = "page", blocks: str = "blocks",
               found: str | None = None, has_images: Column | None = None, image_share: Column | None = None,
               lang: Column | None = None, translate_all: bool = False, page_filter: Column | None = None) -> DataFrame:
    """One row per segment: keys, page, block, seg_id, text, box, font_size, color, bold, vertical, table_like,
    recognised, needs, line_boxes.

    ``blocks`` and ``found`` are the text layer and the recognised one, of type
    ``BLOCKS``; ``found`` may be missing or null. ``lang`` is a recognition code,
    null when unknown. Segments of a page are numbered before whole blocks are culled.
    """
    if page_filter is not None:
        pages = pages.where(page_filter)
    none = F.lit(None)
    rows = pages.select(
        *keys, page, _whole(F.col(blocks)).alias("_text"), _whole(F.col(found) if found else none).alias("_found"),
        (F.lit(False) if has_images is None else has_images).alias("_images"),
        (F.lit(0.0) if image_share is None else image_share).alias("_share"),
        (none if lang is None else lang).cast("string").alias("_lang"))
    rows = rows.withColumn("_rule", scripts.script_rule(F.col("_lang")))
    rows = rows.select(*keys, page, "_lang", "_rule", choose_layer(
        F.col("_text"), F.col("_found"), F.col("_images"), F.col("_share"), F.col("_lang"), F.col("_rule")).alias("_layer"))
    sizes = F.flatten(F.transform(F.col("_layer.blocks"), lambda b: F.flatten(F.transform(
        b["lines"], lambda ln: F.transform(ln["spans"], _size)))))
    floor = F.lit(K.OUTLIER_FONT_FLOOR)
    recognised = F.col("_layer.recognised")
    limit = F.greatest(floor, upper_median_of(sizes) * K.OUTLIER_FONT_FACTOR)  # nulls are skipped
    rows = rows.withColumn("_limit", F.when(recognised, limit).otherwise(floor))
    made = F.flatten(F.transform(F.col("_layer.blocks"), lambda b: _segments_of(
        b, recognised, F.col("_lang"), F.col("_rule"), F.col("_limit"), translate_all)))
    numbered = F.transform(made, lambda s, i: F.struct(i.alias("block"), s["segment"].alias("segment"), s["culled"].alias("culled")))
    rows = rows.select(*keys, page, F.explode(F.filter(numbered, lambda s: ~s["culled"])).alias("_s"))
    fields = ["text", "box", "font_size", "color", "bold", "vertical", "table_like", "recognised", "needs", "line_boxes"]
    return rows.select(*keys, page, F.col("_s.block").alias("block"), segment_id(F.col(page), F.col("_s.block")).alias("seg_id"),
                       *[F.col(f"_s.segment.{f}").alias(f) for f in fields])
