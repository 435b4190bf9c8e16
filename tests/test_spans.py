"""The span scan: decided in the row, and on odd pages."""

from pyspark.sql import functions as F

from folioflow.operators import spans
from folioflow.plans.inputs import span_pages

PAGES = f"doc_id long, page int, blocks {spans.BLOCKS}, found {spans.BLOCKS}, images boolean, share double, lang string"


def span(text, size=10.0, color=0, flags=0, font="Sans"):
    return text, size, color, flags, font


def line(*parts, at=(0.0, 0.0, 50.0, 10.0), turned=False):
    return list(parts), at, 0.0 if turned else 1.0, 1.0 if turned else 0.0


def block(*lines):
    return (0.0, 0.0, 600.0, 800.0), list(lines)


def scan(spark, *rows):
    pages = spark.createDataFrame(list(rows), PAGES)
    return spans.scan_spans(pages, found="found", has_images=F.col("images"), image_share=F.col("share"), lang=F.col("lang"))


def test_no_exchange_in_the_plan(spark, sf, capsys):
    pages = span_pages(spark, sf)
    spans.scan_spans(pages, found="found", has_images=F.col("has_images"), image_share=F.col("image_share"), lang=F.col("lang")).explain()
    assert "Exchange" not in capsys.readouterr().out


def test_title_and_body_part_and_styles_follow_the_majority(spark):
    title = line(span("A Title", 36.0, 255, 16), at=(40.0, 10.0, 300.0, 46.0))
    body = line(span("the body ", 17.0), span("of it", 17.0), span("!", 12.0, 3, 0, "Serif-Bold"), at=(40.0, 50.0, 300.0, 67.0))
    more = line(span("goes on", 17.0), at=(41.0, 70.0, 300.0, 87.0))
    got = scan(spark, (1, 0, [block(title, body, more)], None, None, None, None)).collect()
    assert [(r.seg_id, r.text, r.font_size, r.color, r.bold, r.table_like) for r in got] == [
        ("page_001_block_000", "A Title", 36.0, "#0000ff", True, False),
        ("page_001_block_001", "the body of it!\ngoes on", 17.0, "#000000", False, False)]
    assert tuple(got[1].box) == (40.0, 50.0, 300.0, 87.0) and len(got[1].line_boxes) == 2


def test_tables_are_cut_by_row_and_vertical_columns_stay_together(spark):
    cells = block(line(span("left"), at=(10.0, 0.0, 50.0, 10.0)), line(span("right"), at=(200.0, 0.0, 250.0, 10.0)),
                  line(span("right below"), at=(205.0, 12.0, 250.0, 22.0)), line(span("far below"), at=(205.0, 90.0, 250.0, 99.0)))
    columns = block(*[line(span(t), at=(x, 0.0, x + 10.0, 90.0), turned=True) for t, x in (("縦書", 100.0), ("き文", 80.0))])
    rows = block(*[line(span("縦"), at=(x, y, x + 10.0, y + 20.0), turned=True) for x, y in ((100.0, 0.0), (40.0, 300.0))])
    letters = block(*[line(span(c), at=(10.0, i * 20.0, 20.0, i * 20.0 + 10.0)) for i, c in enumerate("一二三")])
    got = scan(spark, (1, 4, [cells, columns, rows, letters], None, None, None, None)).collect()
    assert [(r.block, r.text, r.table_like, r.vertical) for r in got] == [
        (0, "left", True, False), (1, "right\nright below", True, False), (2, "far below", True, False),
        (3, "縦書\nき文", False, True), (4, "縦", True, True), (5, "縦", True, True), (6, "一\n二\n三", False, True)]
    assert got[0].seg_id == "page_005_block_000"


def test_recognised_layer_takes_over_and_is_checked(spark):
    junk = [block(line(*[span("7#") for _ in range(20)]))]
    good = [block(line(span("readable words here")), line(span("and more of them"), at=(0.0, 12.0, 50.0, 22.0)), line(span("99 99"), at=(20.0, 24.0, 50.0, 34.0))),
            block(*[line(span(t), at=(x, 0.0, x + 9.0, 9.0)) for t, x in (("words", 0.0), ("1", 90.0), ("2", 180.0), ("3", 270.0), ("4", 360.0))]),
            block(line(span("HUGE words", 99.0)))]
    plain = [block(line(span("a text layer that is long enough")))]
    rows = [(1, 0, junk, good, True, 0.9, "eng"), (2, 0, junk, good, True, 0.9, None), (3, 0, plain, good, True, 0.9, "eng"),
            (4, 0, [], good, True, 0.0, "eng"), (5, 0, [], good, False, 0.0, "eng"), (6, 0, junk, None, True, 0.9, "eng"),
            (7, 0, junk, good, True, 0.2, "eng")]
    got = {}
    for r in scan(spark, *rows).collect():
        got.setdefault(r.doc_id, []).append((r.block, r.text, r.recognised))
    kept = [(0, "readable words here\nand more of them\n99 99", True)]  # one of five cells passes: culled; the huge one is an outlier
    assert got == {1: kept, 3: [(0, "a text layer that is long enough", False)], 4: kept,
                   6: [(0, "7#" * 20, False)], 7: [(0, "7#" * 20, False)]}


def test_odd_pages(spark):
    holes = [None, ((0.0, 0.0, 9.0, 9.0), None), ((0.0, 0.0, 9.0, 9.0), [None, (None, None, None, None), ([None, span(None), span("x", None, None, None, None)], None, None, None)])]
    nowhere = [(None, [([span("no place")], None, 1.0, 0.0), ([span("at all")], None, 1.0, 0.0)])]
    got = scan(spark, (1, 0, None, None, None, None, None), (2, 0, [], [], True, None, "eng"), (3, 0, holes, holes, False, 0.9, None),
               (4, 0, nowhere, None, False, None, None), (None, None, nowhere, None, None, None, None)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, "no place\nat all"), (3, "x"), (4, "no place\nat all")]
    assert scan(spark).count() == 0


def test_one_page_of_many_spans(spark):
    many = spark.range(1).select(
        F.lit(1).cast("long").alias("doc_id"), F.lit(0).alias("page"),
        F.array(F.struct(F.lit(None).cast(spans.BOX).alias("box"), F.transform(F.sequence(F.lit(0), F.lit(49_999)), lambda i: F.struct(
            F.array(F.struct(F.lit("word").alias("text"), (10.0 + i % 3).alias("size"), F.lit(0).alias("color"), F.lit(0).alias("flags"),
                             F.lit("Sans").alias("font"))).alias("spans"),
            F.struct(F.lit(0.0).alias("x0"), (i * 12.0).alias("y0"), F.lit(50.0).alias("x1"), (i * 12.0 + 10.0).alias("y1")).alias("box"),
            F.lit(1.0).alias("dx"), F.lit(0.0).alias("dy"))).alias("lines"))).alias("blocks"))
    row = spans.scan_spans(many).first()
    assert len(row.line_boxes) == 50_000 and row.font_size == 10.0
