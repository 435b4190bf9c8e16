"""The given tables shaped into the inputs the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import geometry as G
from folioflow.functions.text import has_letter, segment_lines
from folioflow.operators import blocked
from folioflow.operators.segments import scan


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table, as it is."""
    return spark.read.parquet(f"{sf}/{name}.parquet")


def segments(spark: SparkSession, sf: str) -> DataFrame:
    return scan(table(spark, sf, "documents"))


def marked_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with literals of every protected kind around their whole text."""
    d = table(spark, sf, "documents")
    head = F.concat(
        F.lit("`run "), F.col("doc_id"), F.lit("` see [the page](http://x.test/"), F.col("doc_id"),
        F.lit(") or <b>mail</b> u"), F.col("doc_id"), F.lit("@x.test, http://y.test/a?b="),
        F.col("doc_id"), F.lit(" @user"), F.col("doc_id"), F.lit(" #tag\n**bold** and __strong__\n"),
    )
    tail = F.concat(F.lit("\n*slanted* and _leaning_ "), F.col("doc_id"), F.lit("\n```x = 1\n```"))
    return d.select("doc_id", F.concat(head, F.col("text"), tail).alias("text"))


MARKED_SQL = """
marked AS (
  SELECT doc_id, '`run ' || doc_id || '` see [the page](http://x.test/' || doc_id
    || ') or <b>mail</b> u' || doc_id || '@x.test, http://y.test/a?b=' || doc_id
    || ' @user' || doc_id || ' #tag' || chr(10) || '**bold** and __strong__' || chr(10) || text
    || chr(10) || '*slanted* and _leaning_ ' || doc_id || chr(10) || '```x = 1' || chr(10) || '```' AS text
  FROM documents)"""


def talk(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as segments: a speaker label, then the lines of each turn."""
    c = table(spark, sf, "conversations")
    parts = F.concat(F.array(F.concat(F.col("role"), F.lit(":"))), segment_lines(F.col("text")))
    return c.select("conv_id", "turn", F.posexplode(parts).alias("sub", "text")).withColumn(
        "needs", has_letter(F.col("text"))
    )


def page_status(spark: SparkSession, sf: str) -> DataFrame:
    """Events as pages of per-user documents: user_id, page (from 1), event_type, value, ts."""
    e = table(spark, sf, "events")
    rows = blocked.with_block(e, F.col("event_id"))
    return blocked.row_number(rows, ["user_id"], ["event_id"], "page").withColumn(
        "page", F.col("page").cast("int")
    ).drop(blocked.BLOCK)


STATUS_SQL = """
status AS (
  SELECT event_id, user_id, event_type, value, ts, props,
    CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS page
  FROM events)"""


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as text boxes of pages; ``id`` is unique within a page."""
    li = table(spark, sf, "lineitem")
    x0 = F.pmod("l_partkey", F.lit(50)) * 10.0
    y0 = F.col("l_linenumber") * 20.0
    size = 8.0 + F.pmod("l_suppkey", F.lit(5))
    words = F.concat(
        F.lit("w"), F.col("l_partkey"),
        F.when(F.pmod("l_suppkey", F.lit(3)) == 0, F.lit(".")).otherwise(F.lit("")),
    )
    return li.select(
        F.col("l_orderkey").alias("page"),
        (F.col("l_linenumber").cast("bigint") * 10_000_000_000
         + F.col("l_partkey") * 10_000 + F.col("l_suppkey")).alias("id"),
        F.col("l_linenumber").alias("line"),
        G.box(x0, y0, x0 + F.col("l_quantity"), y0 + 12.0).alias("box"),
        size.alias("size"),
        F.pmod("l_partkey", F.lit(3)).alias("color"),
        (F.pmod("l_suppkey", F.lit(2)) == 0).alias("bold"),
        (F.pmod("l_partkey", F.lit(2)) == 0).alias("vertical"),
        words.alias("text"), F.concat("l_returnflag", "l_linestatus").alias("mark"),
    )


BOXES_SQL = """
boxes AS (
  SELECT row_number() OVER () AS rid, l_orderkey AS page,
    CAST(l_linenumber AS BIGINT) * 10000000000 + l_partkey * 10000 + l_suppkey AS id,
    l_linenumber AS line,
    (l_partkey % 50) * 10.0::DOUBLE AS x0, l_linenumber * 20.0::DOUBLE AS y0,
    (l_partkey % 50) * 10.0::DOUBLE + l_quantity AS x1, l_linenumber * 20.0::DOUBLE + 12.0::DOUBLE AS y1,
    8.0::DOUBLE + (l_suppkey % 5) AS size, l_partkey % 3 AS color,
    l_suppkey % 2 = 0 AS bold, l_partkey % 2 = 0 AS vertical,
    'w' || l_partkey || CASE WHEN l_suppkey % 3 = 0 THEN '.' ELSE '' END AS text,
    l_returnflag || l_linestatus AS mark
  FROM lineitem)"""


PAGE_LINES, BLOCK_LINES = 24, 4
_X = [40.0, 40.0, 42.0, 70.0, 40.0, 40.0, 200.0]
_SIZES = [10.0, 10.0, 10.5, 16.0, 31.5]


def span_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as pages of blocks, lines and spans, some with a recognised layer: one row per page."""
    def pick(values, n):
        return F.array(*[F.lit(v) for v in values])[n % len(values)]

    def digits(t):
        return F.regexp_replace(t, "[A-Za-z]", "7")

    def spans(line, spoil):
        return F.transform(F.split(line, ", "), lambda s: F.struct(
            F.when(spoil, digits(s)).otherwise(s).alias("text"), pick(_SIZES, F.length(s)).alias("size"),
            (F.length(s) % 3 * 255).alias("color"), F.when(F.length(s) % 4 == 0, 16).otherwise(2).alias("flags"),
            F.when(F.length(s) % 6 == 1, "Sans-Bold").otherwise("Sans").alias("font")))

    def layer(lines, spoil):
        def one(line, i, block):
            x0, y0 = pick(_X, F.length(line) + i), (i + block * BLOCK_LINES) * 14.0
            turned = (F.col("doc_id") + block) % 5 == 0
            return F.struct(spans(line, spoil(line)).alias("spans"), G.box(x0, y0, x0 + F.length(line) * 2.0, y0 + 12.0).alias("box"),
                            F.when(turned, 0.0).otherwise(1.0).alias("dx"), F.when(turned, 1.0).otherwise(0.0).alias("dy"))

        last = F.floor((F.size(lines) - 1) / BLOCK_LINES).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.struct(
            G.box(F.lit(0), F.lit(0), F.lit(600), F.lit(800)).alias("box"),
            F.transform(F.slice(lines, b * BLOCK_LINES + 1, F.lit(BLOCK_LINES)), lambda line, i: one(line, i, b)).alias("lines")))

    d = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.split("text", "\n").alias("all"))
    last = F.floor((F.size("all") - 1) / PAGE_LINES).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda p: F.slice("all", p * PAGE_LINES + 1, F.lit(PAGE_LINES)))
    pages = d.select("doc_id", F.posexplode(cut).alias("page", "lines"))
    n = F.col("doc_id")
    return pages.select(
        "doc_id", "page", layer(F.col("lines"), lambda line: n % 6 == 0).alias("blocks"),
        F.when(n % 4 != 1, layer(F.col("lines"), lambda line: F.length(line) % 3 == 0)).alias("found"),
        (n % 2 == 0).alias("has_images"), F.when(n % 12 == 10, 0.1).otherwise(0.8).alias("image_share"),
        F.when(n % 5 != 3, "eng").alias("lang"))


def _picked(values, n: str) -> str:
    return f"CAST([{', '.join(map(str, values))}] AS DOUBLE[])[({n}) % {len(values)} + 1]"


#: spans (doc_id, page, block, k, j, line_len, raw, spoilt, and what the layers share); layer 0 is the text, 1 recognition.
SPANS_SQL = f"""
page_lines AS (SELECT doc_id, i // {PAGE_LINES} AS page, i % {PAGE_LINES} // {BLOCK_LINES} AS block, i % {BLOCK_LINES} AS k, t FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
  FROM documents WHERE text IS NOT NULL)),
raw_spans AS (SELECT doc_id, page, block, k, length(t) AS n, unnest(string_split(t, ', ')) AS s,
  generate_subscripts(string_split(t, ', '), 1) AS j FROM page_lines),
spans AS (SELECT doc_id, page, block, k, j, layer, n,
    CASE WHEN (layer = 0 AND doc_id % 6 = 0) OR (layer = 1 AND n % 3 = 0) THEN regexp_replace(s, '[A-Za-z]', '7', 'g') ELSE s END AS s,
    {_picked(_SIZES, 'length(s)')} AS size, length(s) % 3 * 255 AS color, length(s) % 4 = 0 OR length(s) % 6 = 1 AS bold,
    {_picked(_X, 'n + k')} AS x0, (k + block * {BLOCK_LINES}) * 14.0::DOUBLE AS y0, (doc_id + block) % 5 = 0 AS turned
  FROM raw_spans, range(2) l(layer) WHERE layer = 0 OR doc_id % 4 <> 1)"""


def glossary_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Words of part names with an upper-case target: source, target."""
    p = table(spark, sf, "part")
    word = p.select(F.explode(F.split("p_name", " ")).alias("source")).distinct()
    return word.withColumn("target", F.upper("source"))


TERMS_SQL = """
terms AS (
  SELECT DISTINCT source, upper(source) AS target
  FROM (SELECT unnest(string_split(p_name, ' ')) AS source FROM part))"""
