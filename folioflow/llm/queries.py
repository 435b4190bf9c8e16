"""One query per operator, over whole tables and with production parameters."""

from __future__ import annotations

from folioflow.llm.registry import documents, query


@query()
def op3_pieces(spark, sf):
    """Ids of every text and what they decode to, as digests."""
    from folioflow.llm.pieces import piece_digests

    return piece_digests(documents(spark, sf))


@query()
def op7_secrets(spark, sf):
    """Findings of every text, single patterns and linked parts."""
    from folioflow.llm.secrets import scan_secrets

    return scan_secrets(documents(spark, sf))


_BENCH_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (
    SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, win FROM dw SEMI JOIN bw USING (n, win)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (
    SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit JOIN bw USING (n, win)) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id"""


@query(_BENCH_SQL)
def op4_decontamination(spark, sf):
    """Which words of every document stand in benchmark windows?"""
    from folioflow.llm.decontam import contamination

    return contamination(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))


@query()
def op6_simhash(spark, sf):
    """Fingerprint and near-duplicate group of every document."""
    from folioflow.llm.simhash import near_duplicates

    return near_duplicates(documents(spark, sf))


@query()
def op10_language(spark, sf):
    """Predicted language of every document."""
    from folioflow.llm.language import language_of

    return language_of(documents(spark, sf))


def _license_sql() -> str:
    from folioflow.llm.licenses import TEMPLATES

    rows = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in TEMPLATES.items())
    grams = ("CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), "
             "lambda i: w[i] || ' ' || w[i + 1])) ELSE w END")
    return rf"""
WITH t AS (SELECT license, {grams} AS g FROM (
    SELECT license, regexp_extract_all(lower(body), '[\p{{L}}\p{{N}}]+') AS w FROM (VALUES {rows}) v(license, body))),
u AS (SELECT doc_id, 'line' AS unit, i - 1 AS unit_no, l[i] AS body FROM (
    SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
  UNION ALL SELECT doc_id, 'block', i - 1, l[i] FROM (
    SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (
      SELECT doc_id, string_split_regex(text, '\n[\t\r\x20]*\n\s*') AS l FROM documents))
  WHERE contains(trim(l[i]), chr(10))),
ug AS (SELECT doc_id, unit, unit_no, {grams} AS g FROM (
    SELECT doc_id, unit, unit_no, regexp_extract_all(lower(body), '[\p{{L}}\p{{N}}]+') AS w FROM u)),
s AS (SELECT doc_id, unit, unit_no, license, len(ug.g) AS n_grams, len(list_intersect(ug.g, t.g)) AS n_shared,
    2.0 * len(list_intersect(ug.g, t.g)) / (len(ug.g) + len(t.g)) AS dice FROM ug, t)
SELECT doc_id, unit, unit_no, license, n_grams, n_shared, round(dice, 9) AS dice FROM s WHERE dice >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, unit, unit_no ORDER BY dice DESC, license) = 1"""


@query(_license_sql())
def op2_licenses(spark, sf):
    """The licence that each line or block of every document is nearest to."""
    from folioflow.llm.licenses import license_matches

    return license_matches(documents(spark, sf))


@query(r"""
WITH l AS (SELECT doc_id, i, x, translate(regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM (
    SELECT doc_id, s[i] AS x, i FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (
      SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)))),
hot AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.*, keeper IS NOT NULL AND keeper <> doc_id AS dropped FROM l LEFT JOIN hot USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id""")
def op5_lines(spark, sf):
    """Lines that many documents hold stay in the last of them only."""
    from folioflow.llm.lines import dedup_report

    return dedup_report(documents(spark, sf))


@query()
def op9_scores(spark, sf):
    """Log probability of every text, by words and by the weighted context trees."""
    from pyspark.sql import functions as F

    from folioflow.llm.ctw import scores

    return scores(documents(spark, sf)).select(
        "doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score",
        "bits_per_byte")


@query("""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substring(h, 2 * i + 1, 100) AS s FROM (
  SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d)),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) < doc_id AS hit FROM w),
p AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM m WHERE hit),
g AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END)
  OVER (PARTITION BY doc_id ORDER BY i) AS run FROM p),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, run),
k AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f, a AS t FROM r
  UNION ALL SELECT d.doc_id, coalesce(max(b), 0), any_value(length(h)) // 2 FROM d LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id),
kept AS (SELECT doc_id, string_agg(substring(h, 2 * f + 1, 2 * (t - f)), '' ORDER BY f) AS h FROM k JOIN d USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN n ON n.doc_id = d.doc_id""")
def op8_suffixes(spark, sf):
    """Bytes of every text that a smaller document holds in strings of fifty."""
    from folioflow.llm.suffixes import dedup_report

    return dedup_report(documents(spark, sf))


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5""")
def op1_neighbours(spark, sf):
    """The five largest inner products for every fiftieth vector."""
    from pyspark.sql import functions as F

    from folioflow.llm.neighbours import top_k

    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    return top_k(rows, F.col("vec_id") % 50 == 0)


def _book_sql() -> str:
    """Four unrolled rounds; products of whole doubles below 2^53 are exact in DuckDB too."""
    step = """
a{r} AS MATERIALIZED (SELECT p, k, any_value(v) AS v, arg_min(j, [d, j]) AS j, min(d) AS d FROM (
    SELECT x.p, x.k, x.v, c.j, list_inner_product(c.v, c.v) - 2 * list_inner_product(x.v, c.v) + list_inner_product(x.v, x.v) AS d
    FROM x JOIN c{r} c ON c.p = x.p) GROUP BY p, k)"""
    move = """,
m{n} AS (SELECT p, j, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS v FROM (
    SELECT p, j, i, sum(CAST(v[i] AS BIGINT)) AS s, count(*) AS n FROM (
      SELECT p, j, v, unnest(range(1, len(v) + 1)) AS i FROM a{r}) GROUP BY p, j, i) GROUP BY p, j),
c{n} AS MATERIALIZED (SELECT c.p, c.j, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{n} m ON m.p = c.p AND m.j = c.j),"""
    rounds = "".join(step.format(r=r) + (move.format(r=r, n=r + 1) if r < 4 else "") for r in range(5))
    return f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT p, vec_id AS k, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] AS v FROM v, range(4) t(p)),
c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY k) - 1 AS j, v FROM x QUALIFY j < 256),{rounds},
e AS (SELECT k, string_agg(format('{{:02x}}', j), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 GROUP BY k),
h AS (SELECT sha256(string_agg(CAST(CAST(v[i] AS BIGINT) AS VARCHAR), ',' ORDER BY p, j, i)) AS codebooks_sha256 FROM (
  SELECT p, j, v, unnest(range(1, len(v) + 1)) AS i FROM c4))
SELECT v.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM v JOIN e ON e.k = v.vec_id, h"""


@query(_book_sql())
def op11_codes(spark, sf):
    """Codes of every vector, and how far they are from it."""
    from folioflow.llm.quantize import compress

    return compress(spark.read.parquet(f"{sf}/embeddings.parquet"))


def _chat_sql() -> str:
    from folioflow.llm.chat import BEGIN, CLOSE, CONTROLS, END, OPEN, ROLE

    def escaped(column: str) -> str:
        out = f"replace({column}, '\\', '\\\\')"
        for c in CONTROLS:
            out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
        return out

    return f"""
WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST({len(BEGIN)} + sum(length({escaped('text')}) + {len(END)} + CASE WHEN role = 'assistant' THEN 0
    ELSE length({escaped('role')}) + {len(OPEN + ROLE + CLOSE)} END) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id"""


@query(_chat_sql())
def op12_chats(spark, sf):
    """All conversations as training text, and what can be read back from it."""
    from pyspark.sql import functions as F

    from folioflow.llm.chat import chat_digests

    said = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat_digests(said.unionByName(tricky))


@query("""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM v a, v c WHERE a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3""")
def op13_negatives(spark, sf):
    """Hard negatives of every fiftieth vector and its nearest rows of the same label."""
    from pyspark.sql import functions as F

    from folioflow.llm.negatives import mine

    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return mine(rows, F.col("vec_id") % 50 == 0, label)
