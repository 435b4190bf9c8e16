"""Queries over boxes, lines and blocks of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow import constants as K
from folioflow.functions import geometry as G
from folioflow.functions import scripts
from folioflow.operators import blocked, layout, merging, segments, spans, spatial
from folioflow.plans import sqlparts as S
from folioflow.plans.inputs import BOXES_SQL, SPANS_SQL, boxes, span_pages, table
from folioflow.plans.registry import query
from folioflow.sources.files import tsv_words

_XY = ["x0", "y0", "x1", "y1"]


def _flat(c="box"):
    return [F.col(f"{c}.{a}").alias(a) for a in _XY]


# --- segments from spans ------------------------------------------------------

_LATIN = K.SCRIPT_RULES["latin"]


def _latin(text: str) -> str:
    """Does a text pass for English?"""
    compact = S.sub(text, K.SPACE, "")
    hits = f"length({S.sub(compact, f'[^{_LATIN[0]}]', '')})"
    return f"({compact} <> '' AND {hits} >= {_LATIN[2]} AND {hits} / length({compact}) >= {_LATIN[1]})"


_SPAN_SCAN = f"""
WITH {SPANS_SQL},
facts AS (SELECT doc_id, page, sum(length(s)) FILTER (layer = 0) AS chars, coalesce(sum(length(s)) FILTER (layer = 1), 0) AS found,
    count(*) FILTER (layer = 0) AS n,
    count(*) FILTER (layer = 0 AND CASE WHEN doc_id % 5 <> 3 THEN {_latin('s')} ELSE length({S.strip('s')}) > 3 END) AS good
  FROM spans GROUP BY doc_id, page),
doubt AS (SELECT *, chars >= 20 AND doc_id % 12 <> 10 AND good / n < 0.3 AS bad FROM facts),
chosen AS (SELECT doc_id, page, doc_id % 4 <> 1 AND doc_id % 5 <> 3 AND doc_id % 2 = 0 AND (bad OR (chars < 20 AND found > chars)) AS ocr,
    doc_id % 5 = 3 AND doc_id % 2 = 0 AND bad AS dropped FROM doubt),
used AS (SELECT s.*, ocr FROM spans s JOIN chosen USING (doc_id, page) WHERE NOT dropped AND layer = CASE WHEN ocr THEN 1 ELSE 0 END),
lim AS (SELECT doc_id, page, greatest(20.0::DOUBLE, list_sort(list(size))[count(*) // 2 + 1] * 2.2) AS lim FROM used GROUP BY ALL),
asked AS (SELECT doc_id, page, block AS b, count(DISTINCT k) AS asked FROM used GROUP BY ALL),
ln AS (SELECT * FROM (SELECT doc_id, page, block, k, ocr, {S.clean("string_agg(s, '' ORDER BY j)")} AS t, any_value(x0) AS x0, any_value(y0) AS y0,
    any_value(x0) + any_value(n) * 2.0 AS x1, any_value(y0) + 12.0 AS y1, any_value(turned) AS turned, first(size ORDER BY j) AS size1
  FROM used GROUP BY doc_id, page, block, k, ocr) WHERE t <> ''),
sh AS (SELECT doc_id, page, block, count(*) AS n, max(x0) - min(x0) AS xs, max(y0) - min(y0) AS ys, avg(length(t)) AS mc,
    count(*) FILTER (turned) > count(*) / 2.0 AS dir, first(y0 ORDER BY k) AS fy0, first(y1 ORDER BY k) AS fy1, min(k) AS k0
  FROM ln GROUP BY ALL),
apart AS (SELECT l.doc_id, l.page, l.block, bool_or(l.k > sh.k0 AND CASE WHEN least(fy1, y1) <= greatest(fy0, y0) THEN 0.0
    ELSE (least(fy1, y1) - greatest(fy0, y0)) / greatest(least(fy1 - fy0, y1 - y0), 1e-6) END < 0.3) AS apart
  FROM ln l JOIN sh USING (doc_id, page, block) GROUP BY ALL),
shape AS (SELECT doc_id, page, block, dir OR (n > 1 AND mc <= 4 AND ys > xs * 1.5) AS vert, xs, apart FROM sh JOIN apart USING (doc_id, page, block)),
shaped AS (SELECT l.*, vert, CASE WHEN vert THEN xs > 3 AND apart ELSE xs > CASE WHEN ocr THEN 24 ELSE 3 END END AS tab
  FROM ln l JOIN shape USING (doc_id, page, block)),
cut AS (SELECT *, lag(x0) OVER w AS px, lag(y1) OVER w AS py, lag(size1) OVER w AS ps FROM shaped
  WINDOW w AS (PARTITION BY doc_id, page, block ORDER BY k)),
grp AS (SELECT *, sum(CASE WHEN px IS NULL OR (tab AND (abs(x0 - px) > 25 OR greatest(y0 - py, 0) > ps * 2.5))
    OR (NOT tab AND greatest(size1, ps) / least(size1, ps) > 1.4) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, block ORDER BY k) AS g FROM cut),
seg AS (SELECT doc_id, page, block AS b, g, {S.clean("string_agg(t, chr(10) ORDER BY k)")} AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1,
    max(y1) AS y1, any_value(ocr) AS ocr, any_value(tab) AS tab, CASE WHEN any_value(tab) THEN first(turned ORDER BY k) ELSE any_value(vert) END AS vertical,
    count(*) AS lines FROM grp GROUP BY doc_id, page, block, g),
member AS (SELECT u.*, g FROM used u JOIN grp USING (doc_id, page, block, k)),
sizes AS (SELECT doc_id, page, b, g, first(size ORDER BY c DESC, f) AS font_size FROM (SELECT doc_id, page, block AS b, g, size, count(*) AS c,
  min(k * 1000000 + j) AS f FROM member GROUP BY ALL) GROUP BY ALL),
colors AS (SELECT doc_id, page, b, g, first(color ORDER BY c DESC, f) AS color FROM (SELECT doc_id, page, block AS b, g, color, count(*) AS c,
  min(k * 1000000 + j) AS f FROM member GROUP BY ALL) GROUP BY ALL),
bolds AS (SELECT doc_id, page, block AS b, g, count(*) FILTER (bold) > count(*) / 2.0 AS bold FROM member GROUP BY ALL),
ok AS (SELECT * FROM seg JOIN sizes USING (doc_id, page, b, g) JOIN colors USING (doc_id, page, b, g) JOIN bolds USING (doc_id, page, b, g)
  JOIN lim USING (doc_id, page) WHERE text <> '' AND (NOT ocr OR ({_latin('text')} AND font_size <= lim))),
num AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY b, g) - 1 AS bno, count(*) OVER (PARTITION BY doc_id, page, b) AS kept FROM ok)
SELECT doc_id, page, printf('page_%03d_block_%03d', page + 1, bno) AS seg_id, text, x0, y0, x1, y1, font_size,
  '#' || printf('%06x', color) AS color, bold, vertical, tab AS table_like, ocr AS recognised, {S.hit('text', K.LETTER)} AS needs, lines
FROM num JOIN asked USING (doc_id, page, b)
WHERE NOT (ocr AND tab AND kept / asked < CASE WHEN asked <= 4 THEN 0.5 ELSE 0.3 END)"""


@query("S1 A1 A2 A3 A4 A11 A12 P1 P5 P11 P12 W6 W7 W8", _SPAN_SCAN)
def span_segments(spark, sf):
    """Segments of whole documents laid out as spans, with text and recognised layers."""
    pages = span_pages(spark, sf)
    found = spans.scan_spans(pages, found="found", has_images=F.col("has_images"), image_share=F.col("image_share"), lang=F.col("lang"))
    return found.select("doc_id", "page", "seg_id", "text", *_flat(), "font_size", "color", "bold", "vertical", "table_like",
                        "recognised", "needs", F.size("line_boxes").alias("lines"))


# --- aggregates --------------------------------------------------------------


@query("A1", f"""
WITH {BOXES_SQL},
s AS (SELECT page, size, count(*) AS n, min(id) AS f FROM boxes GROUP BY page, size),
c AS (SELECT page, color, count(*) AS n, min(id) AS f FROM boxes GROUP BY page, color)
SELECT page, font_size, font_color FROM
 (SELECT page, first(size ORDER BY n DESC, f) AS font_size FROM s GROUP BY page)
 JOIN (SELECT page, first(color ORDER BY n DESC, f) AS font_color FROM c GROUP BY page) USING (page)""")
def page_modes(spark, sf):
    b = boxes(spark, sf)
    sizes = layout.mode_first_seen(b, ["page"], "size", F.col("id"), "font_size")
    return sizes.join(layout.mode_first_seen(b, ["page"], "color", F.col("id"), "font_color"), "page")


@query("A2 A4 A16", f"""
WITH {BOXES_SQL}
SELECT page, count(*) AS pieces, sum(CASE WHEN bold THEN 1 ELSE 0 END) > count(*) / 2.0 AS bold,
  min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM boxes GROUP BY page""")
def page_bounds(spark, sf):
    return boxes(spark, sf).groupBy("page").agg(
        F.count("*").alias("pieces"), layout.majority(F.col("bold")).alias("bold"),
        G.union_all(F.col("box")).alias("box"),
    ).select("page", "pieces", "bold", *_flat())


@query("A3 P11", f"""
WITH {BOXES_SQL}, s AS (SELECT *, CASE WHEN l % 9 = 0 THEN size * 4 ELSE size END AS z
  FROM (SELECT *, id % 10000 AS l FROM boxes)),
m AS (SELECT page, list_sort(list(z))[count(*) // 2 + 1] AS median FROM s GROUP BY page)
SELECT s.page, s.id, z AS size, median, greatest(20.0::DOUBLE, round(median * 2.2, 6)) AS size_limit
FROM s JOIN m USING (page) WHERE z > greatest(20.0::DOUBLE, median * 2.2)""")
def size_outliers(spark, sf):
    b = boxes(spark, sf)
    size = F.when(F.col("id") % 10000 % 9 == 0, F.col("size") * 4).otherwise(F.col("size"))
    found = layout.size_outliers(b.withColumn("size", size), ["page"], "size")
    return found.select("page", "id", "size", "median", F.round("size_limit", 6).alias("size_limit"))


@query("A5 S12 D8", """
WITH w AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS word FROM lineitem)
SELECT l_orderkey AS region, l_suppkey % 12 AS block, 1::BIGINT AS par, CAST(l_linenumber AS BIGINT) AS line,
  string_agg('w' || l_partkey, '' ORDER BY word) AS text,
  round(min(l_partkey % 500 * 0.24::DOUBLE), 6) AS x0, round(min(l_linenumber * 40 * 0.24::DOUBLE), 6) AS y0,
  round(max(l_partkey % 500 * 0.24::DOUBLE + l_quantity * 0.24), 6) AS x1,
  round(max(l_linenumber * 40 * 0.24::DOUBLE + 30 * 0.24::DOUBLE), 6) AS y1,
  round(greatest(7.2, 1.0), 6)::DOUBLE AS size
FROM w GROUP BY ALL""")
def recognised_lines(spark, sf):
    """Word TSV of one region per order, parsed back and grouped into lines."""
    li = table(spark, sf, "lineitem")
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    region = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(order)).alias("ws"))

    def row(w, i):
        cells = [
            F.lit(5), F.lit(1), w["l_suppkey"] % 12, F.lit(1), w["l_linenumber"], i + 1,
            w["l_partkey"] % 500, w["l_linenumber"] * 40, w["l_quantity"], F.lit(30), F.lit(96),
            F.concat(F.lit("w"), w["l_partkey"]),
        ]
        return F.concat_ws("\t", *[c.cast("string") for c in cells])

    header = F.lit("level\tpage\tblock\tpar\tline\tword\tleft\ttop\twidth\theight\tconf\ttext")
    junk = F.array(F.lit("4\t1\t1\t1\t1\t0\t1\t1\t1\t1\t-1\t "), F.lit("short\trow"), F.lit(""))
    tsv = F.array_join(F.concat(F.array(header), F.transform("ws", row), junk), "\n")
    words = tsv_words(region.select(F.col("l_orderkey").alias("region"), tsv.alias("tsv")), ["region"], F.col("tsv"))
    lines = layout.words_to_lines(words, ["region"], dpi=300)
    return lines.select(
        "region", *[F.col(c).cast("bigint").alias(c) for c in ("block", "par", "line")], "text",
        *[F.round(f"box.{a}", 6).alias(a) for a in _XY], F.round("size", 6).alias("size"),
    )


@query("A6", f"""
WITH {BOXES_SQL}
SELECT page, line, string_agg(text, chr(10) ORDER BY id) AS text FROM boxes GROUP BY page, line""")
def block_text(spark, sf):
    return layout.join_text(boxes(spark, sf), ["page", "line"], ["id"], "text", "\n")


_SHAPES = f"""{BOXES_SQL},
l AS (SELECT page, id, x0 / 40 AS x0, y0, x1 / 40 AS x1, y1 + (id % 7) * 10 AS y1, vertical, CASE WHEN page % 3 < 2 THEN mark ELSE text END AS text FROM boxes),
g AS (SELECT page, count(*) AS lines, max(x0) - min(x0) AS xs, max(y0) - min(y0) AS ys, avg(length(text)) AS mc,
    sum(CASE WHEN vertical THEN 1 ELSE 0 END) > count(*) / 2.0 AS dir,
    first(y0 ORDER BY id) AS fy0, first(y1 ORDER BY id) AS fy1 FROM l GROUP BY page),
v AS (SELECT *, dir OR (lines > 1 AND mc <= 4 AND ys > xs * 1.5) AS vert FROM g),
o AS (SELECT l.page, bool_or(CASE WHEN least(fy1, y1) <= greatest(fy0, y0) THEN 0.0
    ELSE (least(fy1, y1) - greatest(fy0, y0)) / greatest(least(fy1 - fy0, y1 - y0), 1e-6) END < 0.3) AS apart
  FROM l JOIN v USING (page) GROUP BY l.page)"""


@query("A11 S1", f"""
WITH {_SHAPES}
SELECT page, lines, round(xs, 6) AS x_spread, ys AS y_spread, vert AS block_vertical,
  CASE WHEN vert THEN xs > 3 AND apart ELSE xs > 3 END AS table_like
FROM v JOIN o USING (page)""")
def block_shapes(spark, sf):
    b = boxes(spark, sf)
    box = G.box(F.col("box.x0") / 40, F.col("box.y0"), F.col("box.x1") / 40,
                F.col("box.y1") + F.col("id") % 7 * 10)
    cut = b.select("page", F.col("id").alias("pos"), box.alias("box"), "vertical", 
                   F.when(F.col("page") % 3 < 2, F.col("mark")).otherwise(F.col("text")).alias("text"))
    return layout.block_shape(cut, ["page"]).select(
        "page", "lines", F.round("x_spread", 6).alias("x_spread"), "y_spread", "block_vertical", "table_like"
    )


@query("A12", f"""
WITH {BOXES_SQL}, b AS (SELECT page, count(*) AS candidates, count(*) FILTER (bold AND vertical) AS kept,
  page % 3 <> 0 AS table_like FROM boxes GROUP BY page)
SELECT page, candidates, kept FROM b WHERE NOT (table_like
  AND kept / candidates < CASE WHEN candidates <= 4 THEN 0.5 ELSE 0.3 END)""")
def reliable_blocks(spark, sf):
    b = boxes(spark, sf).groupBy("page").agg(
        F.count("*").alias("candidates"), F.count_if(F.col("bold") & F.col("vertical")).alias("kept")
    ).withColumn("table_like", F.col("page") % 3 != 0)
    return layout.reliable_blocks(b).select("page", "candidates", "kept")


@query("A13", f"""
WITH {BOXES_SQL}
SELECT page, round(least(1.0::DOUBLE, sum((x1 - x0) * (y1 - y0)) / 2000), 6) AS image_share FROM boxes GROUP BY page""")
def image_shares(spark, sf):
    share = layout.image_share(boxes(spark, sf), ["page"], F.lit(2000.0))
    return share.withColumn("image_share", F.round("image_share", 6))


@query("A17", """
WITH r AS (SELECT doc_id, 1 AS psm, text || repeat('1', n_chars::INTEGER) AS t FROM documents
  UNION ALL SELECT doc_id, 2, text FROM documents UNION ALL SELECT doc_id, 3, text || ' ' FROM documents
  UNION ALL SELECT doc_id, 4, '' FROM documents),
c AS (SELECT *, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS h, length(regexp_replace(t, '\\s', '', 'g')) AS n FROM r WHERE t <> ''),
s AS (SELECT doc_id, psm, CASE WHEN n = 0 THEN 0.0 WHEN h >= 2 AND h / n >= 0.5 THEN h / n ELSE h / n * 0.2 END AS score FROM c)
SELECT doc_id, first(psm ORDER BY score DESC, psm) AS psm, round(max(score), 9) AS score FROM s GROUP BY doc_id""")
def best_recognition(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "n_chars")
    attempts = F.array(
        F.struct(F.lit(1).alias("psm"), F.concat("text", F.expr("repeat('1', int(n_chars))")).alias("t")),
        F.struct(F.lit(2).alias("psm"), F.col("text").alias("t")),
        F.struct(F.lit(3).alias("psm"), F.concat("text", F.lit(" ")).alias("t")),
        F.struct(F.lit(4).alias("psm"), F.lit("").alias("t")),
    )
    r = d.select("doc_id", F.explode(attempts).alias("a")).select("doc_id", "a.*")
    best = layout.best_result(r, ["doc_id"], F.col("t"), F.lit("eng"), "psm")
    return best.select("doc_id", "psm", F.round("score", 9).alias("score"))


@query("P12", """
WITH s AS (SELECT conv_id, text FROM conversations UNION ALL SELECT conv_id, left(text, 3) FROM conversations WHERE conv_id % 2 = 0)
SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS chars,
  round(avg(CASE WHEN length(trim(text)) > 3 THEN 1.0 ELSE 0.0 END), 9) AS reliability,
  avg(CASE WHEN length(trim(text)) > 3 THEN 1.0 ELSE 0.0 END) < 0.3 AS unreliable
FROM s GROUP BY conv_id""")
def text_reliability(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "text")
    s = c.unionByName(c.where(F.col("conv_id") % 2 == 0).withColumn("text", F.substring("text", 1, 3)))
    return layout.text_reliability(s, ["conv_id"], None).withColumn("reliability", F.round("reliability", 9))


@query("P12 P5", f"""
WITH s AS (SELECT conv_id, {S.sub('text', S.K.SPACE, '')} AS c, text FROM conversations),
v AS (SELECT conv_id, text, length(regexp_replace(c, '[^A-Za-z]', '', 'g')) AS h, length(c) AS n FROM s)
SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS chars,
  round(avg(CASE WHEN n > 0 AND h >= 2 AND h / n >= 0.5 THEN 1.0 ELSE 0.0 END), 9) AS reliability,
  avg(CASE WHEN n > 0 AND h >= 2 AND h / n >= 0.5 THEN 1.0 ELSE 0.0 END) < 0.3 AS unreliable
FROM v GROUP BY conv_id""")
def script_reliability(spark, sf):
    c = table(spark, sf, "conversations")
    ok = scripts.plausibility(F.col("text"), F.lit("eng"))["ok"]
    return layout.text_reliability(c, ["conv_id"], ok).withColumn("reliability", F.round("reliability", 9))


@query("P17", """
WITH px AS (SELECT l_suppkey AS region, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS pos,
    (l_partkey % 86 + 170 + 120 + l_suppkey % 136 + 130 + l_quantity * 2) / 3 AS v FROM lineitem),
s AS (SELECT *, greatest(1, count(*) OVER (PARTITION BY region) // 3000) AS stride FROM px)
SELECT region, round(avg(v), 6) AS mean, CASE WHEN count(*) >= 12 THEN round(avg(CASE WHEN v >= 210 THEN 1.0 ELSE 0.0 END), 9) ELSE 0.0 END AS bright,
  count(*) >= 12 AND avg(v) >= 185 AND avg(CASE WHEN v >= 210 THEN 1.0 ELSE 0.0 END) >= 0.58 AS safe
FROM s WHERE pos % stride = 0 GROUP BY region""")
def background_safety(spark, sf):
    li = table(spark, sf, "lineitem")
    cut = blocked.with_block(li, F.col("l_orderkey"))
    px = blocked.row_number(cut, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"], "pos").select(
        F.col("l_suppkey").alias("region"), (F.col("pos") - 1).alias("pos"),
        (F.col("l_partkey") % 86 + 170).alias("r"), (F.col("l_suppkey") % 136 + 120).alias("g"),
        (130 + F.col("l_quantity") * 2).alias("b"),
    )
    out = layout.background_safety(px, ["region"])
    return out.select("region", F.round("mean", 6).alias("mean"), F.round("bright", 9).alias("bright"), "safe")


# --- line groups and order ---------------------------------------------------


@query("O1 W8", f"""
WITH {BOXES_SQL}
SELECT page, id, CAST(row_number() OVER (PARTITION BY page ORDER BY y0, x0, id) - 1 AS INTEGER) AS block FROM boxes""")
def block_order(spark, sf):
    flat = blocked.with_counted_block(
        boxes(spark, sf).select("page", "id", *_flat()), ["page"], ["y0", "x0", "id"])
    return segments.number_blocks(flat, ["page"], ["y0", "x0", "id"]).select("page", "id", "block")


@query("W6", f"""
WITH {BOXES_SQL}, p AS (SELECT *, lag(size) OVER (PARTITION BY page ORDER BY id) AS prev FROM boxes)
SELECT page, id, CAST(sum(CASE WHEN greatest(size, prev) / least(size, prev) > 1.4 THEN 1 ELSE 0 END)
  OVER (PARTITION BY page ORDER BY id) AS BIGINT) AS line_group FROM p""")
def size_groups(spark, sf):
    b = blocked.with_counted_block(boxes(spark, sf), ["page"], ["id"])
    return layout.split_by_size(b, ["page"], ["id"], "size").select("page", "id", "line_group")


@query("W7", f"""
WITH {BOXES_SQL}, b AS (SELECT page, id, x0 / 10 AS x0, y0 * 2 AS y0, y1 * 2 AS y1, size FROM boxes),
p AS (SELECT *, lag(x0) OVER w AS px, lag(y1) OVER w AS py, lag(size) OVER w AS ps FROM b
  WINDOW w AS (PARTITION BY page ORDER BY id))
SELECT page, id, CAST(sum(CASE WHEN abs(x0 - px) > 25 OR greatest(y0 - py, 0) > ps * 2.5 THEN 1 ELSE 0 END)
  OVER (PARTITION BY page ORDER BY id) AS BIGINT) AS line_group FROM p""")
def table_groups(spark, sf):
    b = boxes(spark, sf)
    box = G.box(F.col("box.x0") / 10, F.col("box.y0") * 2, F.col("box.x1") / 10, F.col("box.y1") * 2)
    cut = blocked.with_counted_block(b.withColumn("box", box), ["page"], ["id"])
    return layout.group_table_lines(cut, ["page"], ["id"], F.col("box"), F.col("size")).select(
        "page", "id", "line_group"
    )


# --- geometry ----------------------------------------------------------------


@query("F26 F27", f"""
WITH {BOXES_SQL}, f AS (SELECT *, least(x0, 100) AS ax0, least(y0, 50) AS ay0, x0 + 20 AS ax1, y0 + 30 AS ay1 FROM boxes)
SELECT page, id, round({S.y_overlap('', 'a')}, 9) AS y_overlap, {S.gap('', 'a', 'x')} AS x_gap,
  {S.gap('', 'a', 'y')} AS y_gap, {S.overlap_area('', 'a')} AS shared,
  abs(y1 - y0) > abs(x1 - x0) AS vertical_direction,
  CASE WHEN line >= 2 AND (x0 > 0 OR y0 > 0) THEN y0 > x0 * 1.2 ELSE y1 - y0 > (x1 - x0) * 1.1 END AS vertical_layout
FROM f""")
def box_geometry(spark, sf):
    b = boxes(spark, sf)
    box = F.col("box")
    other = G.box(F.least(box["x0"], F.lit(100.0)), F.least(box["y0"], F.lit(50.0)), box["x0"] + 20, box["y0"] + 30)
    b = b.withColumn("other", other)
    o = F.col("other")
    return b.select(
        "page", "id", F.round(G.y_overlap(box, o), 9).alias("y_overlap"), G.x_gap(box, o).alias("x_gap"),
        G.y_gap(box, o).alias("y_gap"), G.overlap_area(box, o).alias("shared"),
        G.is_vertical_direction(box["x1"] - box["x0"], box["y1"] - box["y0"]).alias("vertical_direction"),
        G.is_vertical_layout(F.col("line"), box["x0"], box["y0"], box).alias("vertical_layout"),
    )


# --- neighbour joins ---------------------------------------------------------

_PAIR = f"""
WITH {BOXES_SQL},
c AS (SELECT * FROM boxes WHERE vertical OR length(text) <= 3),
p AS (SELECT a.page, a.id AS a, b.id AS b, greatest(a.size, b.size) AS big, least(a.size, b.size) AS small,
    {S.gap('a.', 'b.', 'x')} AS xg, {S.gap('a.', 'b.', 'y')} AS yg, {S.y_overlap('a.', 'b.')} AS yo,
    a.text AS a_text, b.text AS b_text, a.y0 <= b.y0 AS up, a.x0 >= b.x0 AS rt
  FROM c a JOIN c b ON a.page = b.page AND a.id < b.id AND (a.vertical OR b.vertical))
SELECT page, a, b, xg + yg AS gap FROM p
WHERE big / small <= 1.15
  AND NOT ends_with(CASE WHEN (xg <= big * 0.5 AND up) OR (xg > big * 0.5 AND rt) THEN a_text ELSE b_text END, '.')
  AND CASE WHEN xg <= big * 0.5 THEN yg <= big * 1.5 ELSE xg <= big * 2.5 AND yo > 0.15 END"""


@query("J5 W12a", _PAIR)
def mergeable_pairs(spark, sf):
    pieces = boxes(spark, sf).where(F.col("vertical") | (F.length("text") <= K.LOOSE_FRAGMENT_CHARS))
    found = spatial.mergeable_pairs(
        pieces.select("page", "id", "box", "size", "text", "vertical"), ["page"]
    )
    return found.select("page", F.col("a_id").alias("a"), F.col("b_id").alias("b"), "gap")


@query("J6", f"""
WITH {BOXES_SQL}
SELECT page, id FROM boxes a WHERE NOT EXISTS (
  SELECT 1 FROM boxes b WHERE b.page = a.page AND b.rid <> a.rid AND {S.overlap_area('a.', 'b.')} > 0)""")
def free_boxes(spark, sf):
    return spatial.free_boxes(boxes(spark, sf).select("page", "id", "box"), ["page"]).select("page", "id")


@query("J7", f"""
WITH {BOXES_SQL},
l AS (SELECT a.page, any_value(a.id) AS id, any_value(a.x0) AS x0, any_value(a.y0) AS y0, any_value(a.x1) AS x1, any_value(a.y1) AS y1,
    max(CASE WHEN b.y1 > a.y0 AND b.y0 < a.y1 AND b.x1 <= a.x0 THEN b.x1 ELSE 0 END) AS l,
    min(CASE WHEN b.y1 > a.y0 AND b.y0 < a.y1 AND b.x0 >= a.x1 THEN b.x0 ELSE 600 END) AS r,
    max(CASE WHEN b.x1 > a.x0 AND b.x0 < a.x1 AND b.y1 <= a.y0 THEN b.y1 ELSE 0 END) AS t,
    min(CASE WHEN b.x1 > a.x0 AND b.x0 < a.x1 AND b.y0 >= a.y1 THEN b.y0 ELSE 800 END) AS d
  FROM boxes a LEFT JOIN boxes b ON a.page = b.page
    AND (a.x0, a.y0, a.x1, a.y1) <> (b.x0, b.y0, b.x1, b.y1) GROUP BY a.page, a.rid)
SELECT page, id, least(greatest(greatest(l, 0) + 1.5, x0 - 60), x0)::DOUBLE AS x0,
  least(greatest(greatest(t, 0) + 1.5, y0 - 30), y0)::DOUBLE AS y0,
  greatest(least(least(r, 600) - 1.5, x1 + 60), x1)::DOUBLE AS x1,
  greatest(least(least(d, 800) - 1.5, y1 + 90), y1)::DOUBLE AS y1 FROM l""")
def free_room(spark, sf):
    page = G.box(F.lit(0), F.lit(0), F.lit(600), F.lit(800))
    grown = spatial.free_room(boxes(spark, sf).select("page", "id", "box"), ["page"], page)
    return grown.select("page", "id", *_flat("room"))


_IMAGES = "i AS (SELECT page, id, x0 + id % 3 * 4 AS x0, y0, x0 + id % 3 * 4 + 12 AS x1, y0 + 8 AS y1 FROM boxes)"


@query("J8", f"""
WITH {BOXES_SQL}, {_IMAGES}
SELECT page, id FROM i WHERE EXISTS (SELECT 1 FROM boxes b WHERE b.page = i.page
  AND {S.overlap_area('i.', 'b.')} / 96 > 0.7 AND 96 <= (b.x1 - b.x0) * (b.y1 - b.y0) * 0.5)""")
def covered_images(spark, sf):
    b = boxes(spark, sf).select("page", "id", "box")
    x = F.col("box.x0") + F.col("id") % 3 * 4
    images = b.withColumn("box", G.box(x, F.col("box.y0"), x + 12, F.col("box.y0") + 8))
    return spatial.covered_images(images, b.select("page", "box"), ["page"]).select("page", "id")


# --- sequential merges: their SQL goes step by step over each page ------------

_END_SIGNS = "[" + ", ".join(S.quoted(c) for c in K.SENTENCE_END_CHARS) + "]"


def _merge_sql() -> str:
    """One merge per page and step, over the list of its pieces; pieces of a pair q or p are l[q.i] and l[q.j]."""
    a, b, o = "l[q.i].", "l[q.j].", "l[k]."
    big = f"greatest({a}size, {b}size, 1.0)"
    stacked = f"({S.gap(a, b, 'x')} <= {big} * {K.SAME_COLUMN_GAP})"
    in_order = f"(CASE WHEN {stacked} THEN {a}y0 <= {b}y0 ELSE {a}x0 >= {b}x0 END)"
    first_text = f"CASE WHEN {in_order} THEN {a}text ELSE {b}text END"
    rule = f"""{a}candidate AND {b}candidate AND ({a}vertical OR {b}vertical)
      AND {big} / greatest(least({a}size, {b}size), 0.1) <= {K.MERGE_FONT_RATIO}
      AND NOT list_contains({_END_SIGNS}, right(rtrim({first_text}), 1))
      AND CASE WHEN {stacked} THEN {S.gap(a, b, 'y')} <= {big} * {K.COLUMN_STACK_GAP}
        ELSE {S.gap(a, b, 'x')} <= {big} * {K.COLUMN_SIDE_GAP} AND {S.y_overlap(a, b)} > {K.COLUMN_OVERLAP} END"""
    hits = " AND ".join(f"least(greatest({a}{c}1, {b}{c}1), {o}{c}1) > greatest(least({a}{c}0, {b}{c}0), {o}{c}0)" for c in "xy")
    merged = ", ".join(
        [f"'{c}0': least({a}{c}0, {b}{c}0), '{c}1': greatest({a}{c}1, {b}{c}1)" for c in "xy"]
        + [f"'{c}': CASE WHEN (length({a}text) >= length({b}text) AND {in_order}) OR (length({a}text) > length({b}text) AND NOT {in_order})"
           f" THEN {a}{c} ELSE {b}{c} END" for c in ("id", "size", "candidate")]
        + [f"'text': CASE WHEN {in_order} THEN {a}text || chr(10) || {b}text ELSE {b}text || chr(10) || {a}text END",
           "'vertical': true", f"'members': list_concat({a}members, {b}members)"]).replace("q.", "p.")
    fields = ["x0", "x1", "y0", "y1", "id", "size", "candidate", "text", "vertical", "members"]
    one = ", ".join(f"'{f}': {f}" for f in fields)
    return f"""
WITH RECURSIVE {BOXES_SQL},
piece AS (SELECT *, vertical OR length(trim(text)) <= {K.LOOSE_FRAGMENT_CHARS} AS candidate, [id] AS members FROM boxes),
steps AS (
  SELECT page, 0 AS n, list({{{one}}} ORDER BY id) AS l, NULL::STRUCT(g DOUBLE, i BIGINT, j BIGINT) AS p FROM piece GROUP BY page
  UNION ALL
  SELECT page, n + 1, l, list_sort(list_filter(flatten(list_transform(range(1, len(l) + 1), lambda i: list_transform(range(i + 1, len(l) + 1),
      lambda j: {{'g': {S.gap('l[i].', 'l[j].', 'x')} + {S.gap('l[i].', 'l[j].', 'y')}, 'i': i, 'j': j}}))),
      lambda q: {rule}
        AND len(list_filter(range(1, len(l) + 1), lambda k: k <> q.i AND k <> q.j AND {hits})) = 0))[1] AS p
  FROM (SELECT page, n, CASE WHEN p IS NULL THEN l ELSE list_transform(list_filter(range(1, len(l) + 1), lambda k: k <> p.j),
      lambda k: CASE WHEN k = p.i THEN {{{merged}}} ELSE l[k] END) END AS l, p FROM steps WHERE n = 0 OR p IS NOT NULL)),
last AS (SELECT page, unnest(l) AS m FROM steps WHERE n > 0 AND p IS NULL)
SELECT page, m.id AS id, m.x0 AS x0, m.y0 AS y0, m.x1 AS x1, m.y1 AS y1, m.text AS text, m.size AS size, m.vertical AS vertical,
  true AS needs, array_to_string(list_sort(m.members), ',') AS members FROM last"""


@query("W12 W12a", _merge_sql())
def merged_columns(spark, sf):
    pieces = boxes(spark, sf).select(
        "page", "id", "box", "text", "size", "vertical", F.lit(True).alias("needs")
    )
    return merging.merge_columns(pieces).withColumn("members", F.array_join("members", ","))


def _join_sql() -> str:
    """One row of each page per step: it joins the open row c, or closes it."""
    touch = " AND ".join(f"least(greatest(c.{a}1, r.{a}1), o.{a}1) - greatest(least(c.{a}0, r.{a}0), o.{a}0) > {K.LINE_TOUCH}" for a in "xy")
    ends = "[" + ", ".join(S.quoted(c) for c in K.LINE_END_CHARS) + "]"
    return f"""
WITH RECURSIVE {BOXES_SQL},
rows_ AS (SELECT page, row_number() OVER (PARTITION BY page ORDER BY id) AS pos, x0 / 25 AS x0, y0, x0 / 25 + x1 - x0 AS x1, y1, text, size, bold, color
  FROM boxes),
pages_ AS (SELECT page, list({{'pos': pos, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'text': text, 'size': size, 'bold': bold, 'color': color,
    'members': [pos]}} ORDER BY pos) AS l FROM rows_ GROUP BY page),
steps AS (
  SELECT page, l, 1 AS k, l[1] AS c, l[1:0] AS done FROM pages_
  UNION ALL
  SELECT page, l, k + 1, CASE WHEN joins THEN {{'pos': c.pos, 'x0': least(c.x0, r.x0), 'y0': least(c.y0, r.y0), 'x1': greatest(c.x1, r.x1),
      'y1': greatest(c.y1, r.y1), 'text': rtrim(c.text) || ' ' || ltrim(r.text), 'size': c.size, 'bold': c.bold, 'color': c.color,
      'members': list_append(c.members, r.pos)}} ELSE r END,
    CASE WHEN joins THEN done ELSE list_append(done, c) END
  FROM (SELECT *, c.bold = r.bold AND c.color = r.color AND abs(c.size - r.size) <= {K.LINE_JOIN_FONT}
      AND r.y0 - c.y1 > -c.size AND r.y0 - c.y1 < c.size * {K.LINE_JOIN_GAP}
      AND least(c.x1, r.x1) - greatest(c.x0, r.x0) > 0
      AND (least(c.x1, r.x1) - greatest(c.x0, r.x0)) / greatest(least(c.x1 - c.x0, r.x1 - r.x0), 1e-6) > {K.LINE_JOIN_OVERLAP}
      AND length(c.text) + length(r.text) <= {K.LINE_JOIN_CHARS} AND NOT list_contains({ends}, right(rtrim(c.text), 1))
      AND len(list_filter(done || l[k + 2:], lambda o: {touch})) = 0 AS joins
    FROM (SELECT *, l[k + 1] AS r FROM steps WHERE k < len(l)))),
last AS (SELECT page, unnest(list_append(done, c)) AS m FROM steps WHERE k = len(l))
SELECT page, m.pos AS pos, m.x0 AS x0, m.y0 AS y0, m.x1 AS x1, m.y1 AS y1, m.text AS text, array_to_string(m.members, ',') AS members FROM last"""


@query("W11", _join_sql())
def joined_lines(spark, sf):
    b = boxes(spark, sf)
    box = F.col("box")
    narrow = G.box(box["x0"] / 25, box["y0"], box["x0"] / 25 + box["x1"] - box["x0"], box["y1"])
    numbered = blocked.row_number(
        blocked.with_counted_block(b, ["page"], ["id"]), ["page"], ["id"], "pos"
    )
    rows = numbered.select(
        "page", "pos", narrow.alias("box"), "text", "size", "bold", "color", F.lit(True).alias("needs")
    )
    return merging.join_broken_lines(rows).withColumn("members", F.array_join("members", ","))


_SHARES = (f"least(rest[1].h, e.h) > 0 AND greatest(0, least(rest[1].y + rest[1].h, e.y + e.h) - greatest(rest[1].y, e.y))"
           f" / least(rest[1].h, e.h) > {K.READING_ROW_OVERLAP}")


@query("W13", f"""
WITH RECURSIVE {BOXES_SQL},
r AS (SELECT page, id, x0 AS x, y0 + id % 11 AS y, x1 - x0 AS w, 12.0::DOUBLE + id % 17 AS h FROM boxes),
e AS (SELECT page, y, h, min(id) AS first_id FROM r GROUP BY ALL),
far AS (SELECT *, max(y + h) OVER (PARTITION BY page ORDER BY y, y + h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM e),
b AS (SELECT *, CAST(sum(CASE WHEN y > far THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY y, y + h) AS BIGINT) AS band FROM far),
steps AS (
  SELECT page, band, 0 AS n, list({{'y': y, 'h': h, 'id': first_id}} ORDER BY y + h / 2, first_id) AS rest FROM b GROUP BY page, band
  UNION ALL
  SELECT page, band, n + 1, list_filter(rest, lambda e: e.id <> rest[1].id AND NOT ({_SHARES})) FROM steps WHERE len(rest) > 0),
taken AS (SELECT page, band, n, unnest(list_filter(rest, lambda e: e.id = rest[1].id OR ({_SHARES}))) AS m FROM steps WHERE len(rest) > 0),
placed AS (SELECT r.*, band, CAST(n AS INTEGER) AS "row" FROM r JOIN taken ON r.page = taken.page AND r.y = m.y AND r.h = m.h)
SELECT *, row_number() OVER (PARTITION BY page ORDER BY band, "row", -(x + w / 2), y, y + h / 2, id) AS position FROM placed""")
def reading_order(spark, sf):
    b = boxes(spark, sf)
    rows = b.select(
        "page", "id", F.col("box.x0").alias("x"), (F.col("box.y0") + F.col("id") % 11).alias("y"),
        (F.col("box.x1") - F.col("box.x0")).alias("w"), (12.0 + F.col("id") % 17).alias("h"),
    )
    return merging.reading_order(rows)


def _fit_sql(start: str, width: str) -> str:
    """Words from ``start`` on that fit into one line's share of the text; at least one."""
    room = f"greatest(1, round_even(length(text) * {width} / total, 0))"
    return (f"greatest(1, len(list_filter(range(1, len(w) - {start} + 2), "
            f"lambda t: length(array_to_string(w[{start}:{start} + t - 1], ' ')) <= {room})))")


@query("F30", f"""
WITH b AS (SELECT p_partkey, list_filter(string_split(p_name || ' ' || p_type || '  ' || p_brand, ' '), lambda x: x <> '') AS w,
    list_filter([CAST(p_size % 7 + 1 AS DOUBLE), p_size % 5, p_partkey % 9 + 1], lambda x: x > 0) AS ws FROM part),
t AS (SELECT *, array_to_string(w, ' ') AS text, list_sum(ws) AS total FROM b),
one AS (SELECT *, CASE WHEN len(ws) >= 2 THEN {_fit_sql('1', 'ws[1]')} ELSE 0 END AS a FROM t),
two AS (SELECT *, CASE WHEN len(ws) >= 3 AND a < len(w) THEN a + {_fit_sql('(a + 1)', 'ws[2]')} ELSE a END AS c FROM one)
SELECT p_partkey, array_to_string(list_filter([array_to_string(w[1:a], ' '), array_to_string(w[a + 1:c], ' '),
  array_to_string(w[c + 1:len(w)], ' ')], lambda x: x <> ''), chr(10)) AS text FROM two""")
def fitted_lines(spark, sf):
    """Part names laid over three lines whose widths follow the part."""
    p = table(spark, sf, "part")
    widths = F.array(
        (F.col("p_size") % 7 + 1).cast("double"), (F.col("p_size") % 5).cast("double"),
        (F.col("p_partkey") % 9 + 1).cast("double"),
    )
    name = F.concat("p_name", F.lit(" "), "p_type", F.lit(" \t"), "p_brand")
    return p.select("p_partkey", G.fit_to_lines(name, widths).alias("text"))
