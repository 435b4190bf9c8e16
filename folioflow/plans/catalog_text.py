"""Queries over segment text: scan, predicates, cleaning, tokens, markup, batching."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow import constants as K
from folioflow.functions import geometry as G
from folioflow.functions import markup, naming, prompts, scripts, services, text, tokens
from folioflow.functions.keys import memo_key, memory_key, prompt_key
from folioflow.operators import batching, blocked, context, segments
from folioflow.operators.reconcile import mock_answer, parse_answer, parse_strict
from folioflow.plans import sqlparts as S
from folioflow.plans import translate as plan
from folioflow.plans.inputs import (
    MARKED_SQL, TERMS_SQL, glossary_terms, marked_documents, table, talk,
)
from folioflow.plans.inputs import segments as doc_segments
from folioflow.plans.registry import query

NL = "chr(10)"


# --- scan --------------------------------------------------------------------


@query("S1 W8 P1", f"WITH {S.SEGMENTS} SELECT doc_id, pos, page, block, seg_id, text, needs FROM segs")
def segment_scan(spark, sf):
    return doc_segments(spark, sf)


@query("S2 P3", f"""
WITH {S.SEGMENTS}
SELECT doc_id, pos, page, seg_id FROM segs
WHERE page BETWEEN doc_id % 3 AND doc_id % 3 + 1 OR page = 4""")
def page_filter(spark, sf):
    docs = table(spark, sf, "documents")
    first = F.col("doc_id") % 3 + 1
    spec = F.concat(first, F.lit("-"), first + 1, F.lit(", 5"))
    docs = docs.withColumn("_pages", naming.page_spec(spec, F.lit(1 << 30)))
    pages = docs.select("doc_id", F.explode("_pages").alias("page"))
    return segments.page_clip(segments.scan(docs), pages).select("doc_id", "pos", "page", "seg_id")


@query("S2 U5", """
WITH spec AS (
  SELECT o_orderkey, o_orderkey % 7 AS a, o_orderkey % 7 + o_custkey % 5 - 2 AS b, o_custkey % 40 AS c
  FROM orders),
picked AS (
  SELECT o_orderkey, unnest(range(a, b + 1)) AS page FROM spec WHERE b >= a
  UNION SELECT o_orderkey, c FROM spec)
SELECT o_orderkey, string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) AS pages
FROM picked WHERE page < 30 GROUP BY o_orderkey
UNION ALL
SELECT o_orderkey, '' FROM spec WHERE c >= 30 AND b < a""")
def page_specs(spark, sf):
    o = table(spark, sf, "orders")
    a = F.col("o_orderkey") % 7 + 1
    spec = F.concat(a, F.lit("-"), a + F.col("o_custkey") % 5 - 2, F.lit(" , "),
                    F.col("o_custkey") % 40 + 1, F.lit(","))
    return o.select(
        "o_orderkey", F.array_join(naming.page_spec(spec, F.lit(30)), ",").alias("pages")
    )


@query("A7 P4", f"""
WITH {S.SEGMENTS}
SELECT doc_id, count(*) AS segments, count(*) FILTER (needs) AS targets,
  count(*) FILTER (NOT needs) AS skipped,
  CAST(coalesce(sum(length(text)) FILTER (needs), 0) AS BIGINT) AS target_chars
FROM segs GROUP BY doc_id""")
def run_summary(spark, sf):
    return segments.run_summary(doc_segments(spark, sf), ["doc_id"])


@query("P16", f"""
WITH {S.SEGMENTS}
SELECT doc_id, page, CAST(sum((length(text) - length(replace(text, 'tion', ''))) // 4) AS BIGINT) AS hits
FROM segs WHERE contains(text, 'tion') GROUP BY doc_id, page""")
def page_search(spark, sf):
    found = doc_segments(spark, sf).where(F.contains(F.col("text"), F.lit("tion")))
    return found.groupBy("doc_id", "page").agg(
        F.sum(text.occurrences(F.col("text"), "tion")).alias("hits")
    )


# --- cleaning ----------------------------------------------------------------

_DIRTY = "' ' || chr(57344) || ' x ' || chr(8226) || 'y ' || chr(65533) || chr(7) || '+ - ' || text || '  \t- '"


@query("F1", f"SELECT doc_id, {S.clean(_DIRTY)} AS cleaned FROM documents")
def clean_characters(spark, sf):
    d = table(spark, sf, "documents")
    dirty = F.concat(F.lit("  x •y �\x07+ - "), F.col("text"), F.lit("  \t- "))
    return d.select("doc_id", text.clean_characters(dirty).alias("cleaned"))


_QUOTED = f"'“a”  ‘b’ （c） . end.  next' || repeat({NL}, 4) || text || '  ! so'"
_NORMAL = S.sub(
    S.sub(S.sub(
        "translate(" + _QUOTED + ", '“”‘’（）', '\"\"''''()')", r"[ \t]+", " "
    ), r" ([.,!?])", r"\1"),
    r"\n{3,}", "\n\n",
)


@query("F2", f"SELECT doc_id, {S.strip(S.capitals(_NORMAL))} AS normalized FROM documents")
def normalize_text(spark, sf):
    d = table(spark, sf, "documents")
    raw = F.concat(F.lit("“a”  ‘b’ （c） . end.  next\n\n\n\n"), F.col("text"), F.lit("  ! so"))
    return d.select("doc_id", text.normalize(raw).alias("normalized"))


@query("F3", f"""
WITH raw AS (
  SELECT doc_id, replace(replace(' a ' || chr(13) || chr(10) || '  b' || chr(13) || text || chr(9) || ' ',
    chr(13) || chr(10), {NL}), chr(13), {NL}) AS t FROM documents),
cut AS (
  SELECT doc_id, unnest(string_split(t, {NL})) AS l, generate_subscripts(string_split(t, {NL}), 1) AS i
  FROM raw)
SELECT doc_id, {S.strip(f"string_agg({S.strip(S.sub('l', '[ ' + chr(92) + 't]+', ' '))}, {NL} ORDER BY i)")} AS tidy
FROM cut GROUP BY doc_id""")
def tidy_lines(spark, sf):
    d = table(spark, sf, "documents")
    raw = F.concat(F.lit(" a \r\n  b\r"), F.col("text"), F.lit("\t "))
    return d.select("doc_id", text.tidy_lines(raw).alias("tidy"))


# --- predicates --------------------------------------------------------------


@query("P2", f"WITH {S.TALK} SELECT conv_id, turn, CAST(sub AS INTEGER) AS sub, {S.label('text')} AS is_label FROM talk")
def label_predicate(spark, sf):
    return talk(spark, sf).select(
        "conv_id", "turn", "sub", text.is_label(F.col("text")).alias("is_label")
    )


@query("P10", f"""
WITH {S.SEGMENTS}
SELECT doc_id, pos, {S.hit('text', K.SENTENCE_END + K.SPACE + '*' + chr(92) + 'z')} AS ends FROM segs""")
def sentence_end(spark, sf):
    return doc_segments(spark, sf).select(
        "doc_id", "pos", text.ends_sentence(F.col("text")).alias("ends")
    )


_LANGS = ["jpn+jpn_vert", "kor", "eng", "jpn+jpn_vert+eng+kor", "fra", "", "kor+eng"]
_LANG_SQL = "[" + ", ".join(f"'{x}'" for x in _LANGS) + "][doc_id % 7 + 1]"
_MIXED_SQL = "CASE WHEN doc_id % 11 = 0 THEN ' ' WHEN doc_id % 2 = 0 THEN repeat('漢字かな 한글 ', doc_id % 9) || text ELSE text END"


def _mixed(spark, sf):
    d = table(spark, sf, "documents")
    cjk = F.concat(F.expr("repeat('漢字かな 한글 ', int(doc_id % 9))"), F.col("text"))
    lang = F.element_at(F.array(*[F.lit(x) for x in _LANGS]), (F.col("doc_id") % 7 + 1).cast("int"))
    mixed = F.when(F.col("doc_id") % 11 == 0, " ").when(F.col("doc_id") % 2 == 0, cjk)
    return d.select("doc_id", lang.alias("lang"), mixed.otherwise(F.col("text")).alias("text"))


def _share_sql() -> str:
    rules = {k: v for k, v in K.SCRIPT_RULES.items()}
    jp, ko, la, other = (rules[k] for k in ("japanese", "korean", "latin", "other"))

    def case(value) -> str:
        combos = {
            "jpn+jpn_vert": [jp], "kor": [ko], "eng": [la], "jpn+jpn_vert+eng+kor": [jp, ko, la],
            "fra": [other], "": [la], "kor+eng": [ko, la],
        }
        return "CASE lang " + " ".join(
            f"WHEN '{lang}' THEN {value(used)}" for lang, used in combos.items()
        ) + " END"

    hits = case(lambda r: f"length({S.sub('compact', '[^' + ''.join(x[0] for x in r) + ']', '')})")
    share = case(lambda r: f"{min(x[1] for x in r)}::DOUBLE")
    least = case(lambda r: str(min(x[2] for x in r)))
    return f"""
WITH mixed AS (SELECT doc_id, {_LANG_SQL} AS lang, {_MIXED_SQL} AS text FROM documents),
packed AS (SELECT doc_id, lang, {S.sub('text', K.SPACE, '')} AS compact FROM mixed),
counted AS (SELECT *, {hits} AS hits, {share} AS share, {least} AS least FROM packed)
SELECT doc_id, compact <> '' AND hits >= least AND hits / length(compact) >= share AS ok,
  CASE WHEN compact = '' THEN 0.0 ELSE round(hits / length(compact), 9) END AS ratio,
  CASE WHEN compact = '' THEN 'empty' ELSE 'script=' || hits || '/' || length(compact) END AS reason
FROM counted"""


@query("P5", _share_sql())
def script_plausibility(spark, sf):
    verdict = scripts.plausibility(F.col("text"), F.col("lang"))
    return _mixed(spark, sf).select("doc_id", verdict.alias("v")).select(
        "doc_id", "v.ok", F.round("v.ratio", 9).alias("ratio"), "v.reason"
    )


@query("P6", f"""
WITH mixed AS (SELECT doc_id, {_LANG_SQL} AS lang, {_MIXED_SQL} AS text FROM documents)
SELECT doc_id, CASE WHEN lang = 'jpn+jpn_vert'
  THEN {S.sub(S.sub(S.sub('text', '[A-Za-z]{2,}', ''), K.JAPANESE_KEPT, ''), K.SPACE, '')}
  ELSE {S.strip('text')} END AS kept
FROM mixed""")
def sanitize_recognised(spark, sf):
    return _mixed(spark, sf).select(
        "doc_id", scripts.sanitize_recognised(F.col("text"), F.col("lang")).alias("kept")
    )


@query("F16", """
SELECT doc_id, CASE lang WHEN 'en' THEN 'eng' WHEN 'ko' THEN 'kor' WHEN 'ja' THEN 'jpn+jpn_vert'
  WHEN 'zh' THEN 'chi_sim' ELSE NULL END AS code,
  CASE doc_id % 4 WHEN 0 THEN 'eng' WHEN 1 THEN 'chi_sim' WHEN 2 THEN 'jpn+jpn_vert' ELSE 'fra' END AS named
FROM documents""")
def recognition_codes(spark, sf):
    names = F.array(F.lit(" English"), F.lit("Chinese (Simplified)"), F.lit("일본어"), F.lit("FRENCH "))
    name = F.element_at(names, (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf, "documents").select(
        "doc_id", scripts.ocr_code(F.col("lang")).alias("code"),
        scripts.ocr_code(name).alias("named"),
    )


_TARGETS = ["Korean", " ja", "CHINESE (traditional)", "ru", "French"]
_TARGET_SQL = "[" + ", ".join(f"'{x}'" for x in _TARGETS) + "][doc_id % 5 + 1]"
_MAPPED_SQL = (
    "CASE (doc_id + pos) % 5 WHEN 0 THEN '[모의 번역] ' || text WHEN 1 THEN text WHEN 2 THEN 'ok'"
    " WHEN 3 THEN repeat('漢', 20) || 'ー' ELSE 'Да, ' || text END"
)


def _pairs(spark, sf):
    n = F.col("doc_id") + F.col("pos")
    lang = F.element_at(F.array(*[F.lit(x) for x in _TARGETS]), (F.col("doc_id") % 5 + 1).cast("int"))
    mapped = (
        F.when(n % 5 == 0, prompts.mock_mapping(F.col("text"))).when(n % 5 == 1, F.col("text"))
        .when(n % 5 == 2, "ok").when(n % 5 == 3, F.lit("漢" * 20 + "ー"))
        .otherwise(F.concat(F.lit("Да, "), F.col("text")))
    )
    return doc_segments(spark, sf).select(
        "doc_id", "pos", "text", lang.alias("lang"), mapped.alias("mapped")
    )


_SCRIPT_CASE = "CASE lower(trim(lang)) " + " ".join(
    f"WHEN '{name}' THEN NOT {S.hit('mapped', charset)}"
    for charset, names in K.TARGET_SCRIPTS.items() for name in names
) + " ELSE false END"


@query("P7 P7a", f"""
WITH {S.SEGMENTS},
pairs AS (SELECT doc_id, pos, text, {_TARGET_SQL} AS lang, {_MAPPED_SQL} AS mapped FROM segs)
SELECT doc_id, pos, length({S.strip('mapped')}) >= 15
  AND length({S.sub('text', '[^' + chr(92) + 'p{L}]', '')}) >= 8 AND {_SCRIPT_CASE} AS echo
FROM pairs""")
def untranslated_echo(spark, sf):
    return _pairs(spark, sf).select(
        "doc_id", "pos",
        scripts.is_echo(F.col("text"), F.col("mapped"), F.col("lang")).alias("echo"),
    )


_TALK_REPLY = "CASE WHEN turn % 2 = 0 THEN repeat('answer ', 1 + sub) || '.' ELSE 'ok' END"


@query("P8", f"""
WITH {S.TALK},
p AS (SELECT conv_id, turn, sub, text AS src, {_TALK_REPLY} AS out FROM talk),
q AS (SELECT *, {S.label('src')} AS lab, length(out) <= 15 AND NOT {S.hit('out', '[.!?…]')} AS brief FROM p)
SELECT conv_id, turn, CAST(sub AS INTEGER) AS sub,
  NOT (lab AND NOT brief AND length(out) > length({S.strip('src')}) * 5)
  AND NOT (NOT lab AND length({S.strip('src')}) > 60 AND brief) AS plausible
FROM q""")
def plausible_pairs(spark, sf):
    reply = F.when(F.col("turn") % 2 == 0, F.concat(F.expr("repeat('answer ', 1 + sub)"), F.lit(".")))
    return talk(spark, sf).select(
        "conv_id", "turn", "sub",
        scripts.is_plausible_pair(F.col("text"), reply.otherwise(F.lit("ok"))).alias("plausible"),
    )


@query("P13 P14 X6", f"""
WITH {S.SEGMENTS},
p AS (SELECT doc_id, pos, text || ' #a' AS src, CASE pos % 4 WHEN 0 THEN ' ' WHEN 1 THEN 'x'
  WHEN 2 THEN text || '```' ELSE text || ' #a' END AS out FROM segs)
SELECT doc_id, pos,
  concat_ws(', ', CASE WHEN (length(src) - length(replace(src, '```', ''))) // 3
      <> (length(out) - length(replace(out, '```', ''))) // 3 THEN 'code fences differ' END,
    CASE WHEN length(src) - length(replace(src, '#', ''))
      <> length(out) - length(replace(out, '#', '')) THEN 'headers differ' END) AS structure,
  CASE WHEN {S.strip('out')} = '' THEN 'empty' WHEN length(out) < length(src) * 0.1 THEN 'too short'
    ELSE '' END AS content
FROM p""")
def pair_validators(spark, sf):
    src = F.concat(F.col("text"), F.lit(" #a"))
    out = (
        F.when(F.col("pos") % 4 == 0, " ").when(F.col("pos") % 4 == 1, "x")
        .when(F.col("pos") % 4 == 2, F.concat(F.col("text"), F.lit("```"))).otherwise(src)
    )
    return doc_segments(spark, sf).select(
        "doc_id", "pos",
        F.array_join(markup.structure_faults(src, out), ", ").alias("structure"),
        F.array_join(markup.content_faults(src, out), ", ").alias("content"),
    )


@query("P15", """
SELECT event_id, concat_ws(', ', CASE WHEN value / 100 < 0.8 THEN 'low confidence' END,
  CASE WHEN event_type = 'view' THEN 'empty region' END) AS warnings FROM events""")
def recognition_warnings(spark, sf):
    e = table(spark, sf, "events")
    found = F.when(F.col("event_type") == "view", "").otherwise(F.col("props"))
    return e.select(
        "event_id",
        F.array_join(markup.recognition_warnings(found, F.col("value") / 100), ", ").alias("warnings"),
    )


# --- services ----------------------------------------------------------------

_CODES = [200, 429, 401, 403, 400, 413, 422, 500]
_MESSAGES = [
    "all fine", "Too Many Requests", "API key not valid", "GenerateRequestsPerDay limit",
    "prompt is too long", "Quota exceeded", "request payload", "Unauthorized billing",
    "rate limit; out of credits", "server error 422",
]
_ERRORS = (
    "errs AS (SELECT event_id, [" + ", ".join(map(str, _CODES)) + "][event_id % 8 + 1] AS code, ["
    + ", ".join(f"'{m}'" for m in _MESSAGES) + "][event_id % 10 + 1] || ' ' || props AS msg FROM events)"
)


def _errors(spark, sf):
    def pick(values, n):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("event_id") % n + 1).cast("int"))

    return table(spark, sf, "events").select(
        "event_id", pick(_CODES, 8).alias("code"),
        F.concat(pick(_MESSAGES, 10), F.lit(" "), F.col("props")).alias("msg"),
    )


def _any_sql(words) -> str:
    return "(" + " OR ".join(f"contains(lower(msg), '{w}')" for w in words) + ")"


@query("P9", f"""
WITH {_ERRORS}
SELECT event_id, code = 429 OR {_any_sql(K.RATE_LIMIT_WORDS)} AS rate_limit,
  code IN (401, 403) OR {_any_sql(K.AUTH_WORDS)} AS auth, {_any_sql(K.QUOTA_WORDS)} AS quota,
  code IN (401, 403) OR {_any_sql(K.AUTH_WORDS)} OR {_any_sql(K.QUOTA_WORDS)} AS lasting,
  code IN (400, 413, 422) OR {_any_sql(K.OVERSIZE_WORDS)} AS oversize
FROM errs""")
def service_errors(spark, sf):
    code, msg = F.col("code"), F.col("msg")
    return _errors(spark, sf).select(
        "event_id", services.is_rate_limit(code, msg).alias("rate_limit"),
        services.is_auth(code, msg).alias("auth"), services.is_quota(msg).alias("quota"),
        services.is_lasting(code, msg).alias("lasting"),
        services.is_oversize(code, msg).alias("oversize"),
    )


@query("P9a", f"""
WITH {_ERRORS}
SELECT event_id, {_any_sql(K.BRIEF_RATE_LIMIT_WORDS)} AS rate_limit, {_any_sql(K.BRIEF_AUTH_WORDS)} AS auth,
  {_any_sql(K.BRIEF_QUOTA_WORDS)} AS quota,
  {_any_sql(K.BRIEF_AUTH_WORDS)} OR {_any_sql(K.BRIEF_QUOTA_WORDS)} AS lasting
FROM errs""")
def service_errors_brief(spark, sf):
    msg = F.col("msg")
    return _errors(spark, sf).select(
        "event_id", services.brief_rate_limit(msg).alias("rate_limit"),
        services.brief_auth(msg).alias("auth"), services.brief_quota(msg).alias("quota"),
        services.brief_lasting(msg).alias("lasting"),
    )


@query("F11", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN (event_id % 90) + 0.5 + 2
  WHEN 1 THEN (event_id % 60) + 2.25 + 0 WHEN 2 THEN (event_id % 30) + 2 ELSE 30.0 END::DOUBLE AS delay
FROM events""")
def retry_delays(spark, sf):
    n = F.col("event_id")
    msg = (
        F.when(n % 4 == 0, F.concat(F.lit("Please RETRY in "), n % 90, F.lit(".5 s.")))
        .when(n % 4 == 1, F.concat(F.lit("{'retryDelay': '"), n % 60, F.lit(".25s'}")))
        .otherwise(F.lit("busy"))
    )
    header = F.when(n % 4 == 2, (n % 30).cast("string"))
    return table(spark, sf, "events").select("event_id", services.retry_delay(msg, header).alias("delay"))


@query("F29", """
SELECT event_id, least(pow(2.0, event_id % 6), 15.0) AS wait, least(pow(2.0, event_id % 6), 10.0) AS service_wait
FROM events""")
def backoff_delays(spark, sf):
    n = F.col("event_id") % 6
    return table(spark, sf, "events").select(
        "event_id", services.backoff(n).alias("wait"), services.service_backoff(n).alias("service_wait")
    )


_QUANTS = ["e2b", "4B", "q3_1", "int5", "8b-FLM", "x", "q6", "7b"]
_BITS_SQL = "[2, 4, 3, 5, 8, NULL, 6, 7][p_partkey % 8 + 1]"


@query("F13 F14 F15", f"""
WITH m AS (SELECT p_partkey, CAST({_BITS_SQL} AS INTEGER) AS found FROM part),
b AS (SELECT *, coalesce(found, 4) AS bits FROM m)
SELECT p_partkey, found, bits,
  CAST(CASE WHEN bits <= 4 THEN 450 + floor((bits - 2) / 2.0 * 550) ELSE floor(1000 + (bits - 4) / 4.0 * 1500) END AS INTEGER) AS chars,
  CAST(CASE WHEN bits <= 4 THEN floor(2 + (bits - 2) / 2.0 * 3) ELSE floor(5 + (bits - 4) / 4.0 * 11) END AS INTEGER) AS segments,
  CAST(CASE WHEN bits <= 4 THEN 3072 + (bits - 2) * 512 ELSE 4096 + (bits - 4) * 512 END AS INTEGER) AS tokens,
  CASE WHEN p_partkey % 8 = 4 THEN 'npu' ELSE 'gpu' END AS device
FROM b""")
def model_presets(spark, sf):
    quant = F.element_at(F.array(*[F.lit(q) for q in _QUANTS]), (F.col("p_partkey") % 8 + 1).cast("int"))
    model = F.concat(F.regexp_replace("p_name", " ", "."), F.lit("-"), quant)
    preset = services.batch_preset(model)
    return table(spark, sf, "part").select(
        "p_partkey", services.quant_bits(model).alias("found"), preset.alias("p"),
        services.model_device(model).alias("device"),
    ).select("p_partkey", "found", "p.bits", "p.chars", "p.segments", "p.tokens", "device")


@query("F34", """
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'npu,gpu' WHEN 1 THEN 'gpu,tpu' ELSE '' END AS devices,
  CASE c_custkey % 3 WHEN 1 THEN 'tpu' ELSE '' END AS unknown FROM customer""")
def device_lists(spark, sf):
    n = F.col("c_custkey") % 3
    spec = F.when(n == 0, " NPU ,gpu,").when(n == 1, "GPU, tpu").otherwise(" , ")
    got = services.devices(spec)
    return table(spark, sf, "customer").select(
        "c_custkey", F.array_join(got["devices"], ",").alias("devices"),
        F.array_join(got["unknown"], ",").alias("unknown"),
    )


@query("F12", """
WITH k AS (SELECT c_custkey, c_custkey % 7 AS n FROM customer)
SELECT c_custkey,
  CASE n WHEN 0 THEN 'anthropic' WHEN 1 THEN 'gemini' WHEN 2 THEN 'openai' WHEN 3 THEN 'groq'
    WHEN 4 THEN 'gemini' WHEN 5 THEN 'openai' ELSE NULL END AS provider,
  CASE n WHEN 3 THEN 'm' || c_custkey WHEN 4 THEN 'fast' ELSE NULL END AS model,
  CASE n WHEN 0 THEN 'sk-ant-' || c_custkey WHEN 1 THEN 'AIza' || c_custkey WHEN 2 THEN 'sk-' || c_custkey
    WHEN 3 THEN 'k:' || c_custkey WHEN 4 THEN 'g' || c_custkey WHEN 5 THEN 'z' || c_custkey
    ELSE 'plain' || c_custkey END AS secret
FROM k""")
def key_lines(spark, sf):
    n, k = F.col("c_custkey") % 7, F.col("c_custkey").cast("string")
    line = (
        F.when(n == 0, F.concat(F.lit("sk-ant-"), k)).when(n == 1, F.concat(F.lit(" AIza"), k))
        .when(n == 2, F.concat(F.lit("sk-"), k))
        .when(n == 3, F.concat(F.lit("Groq@m"), k, F.lit(" : k:"), k))
        .when(n == 4, F.concat(F.lit("google@fast:g"), k)).when(n == 5, F.concat(F.lit("GPT: z"), k))
        .otherwise(F.concat(F.lit("plain"), k))
    )
    return table(spark, sf, "customer").select(
        "c_custkey", services.parse_key_line(line).alias("p")
    ).select("c_custkey", "p.provider", "p.model", "p.secret")


@query("F17", f"""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN {S.quoted(K.AUTO_LANGUAGE_TEXT)} ELSE lang END AS language
FROM documents""")
def source_languages(spark, sf):
    raw = F.when(F.col("doc_id") % 3 == 0, " Auto-Detect ").otherwise(F.col("lang"))
    return table(spark, sf, "documents").select(
        "doc_id", services.source_language(raw).alias("language")
    )


@query("F32 F33", """
SELECT event_id, CAST(event_id % 50 AS INTEGER) AS batch, 50 AS batches,
  CAST(event_id % 9 AS INTEGER) AS pages, 9 AS all_pages, (event_id % 50) * 2.0::DOUBLE AS percent,
  CASE WHEN event_id % 50 = 0 THEN NULL ELSE round(value / ((event_id % 50) * 2.0) * (100 - (event_id % 50) * 2.0), 6) END AS eta
FROM events""")
def progress_lines(spark, sf):
    n = F.col("event_id")
    line = F.concat(
        F.lit("  [진행] batch="), n % 50, F.lit("/50 pages="), n % 9, F.lit("/9 pct="), (n % 50) * 2, F.lit(".0")
    )
    p = services.progress_line(line)
    return table(spark, sf, "events").select("event_id", "value", p.alias("p")).select(
        "event_id", "p.*", F.round(services.eta_seconds(F.col("value"), F.col("p.percent")), 6).alias("eta")
    )


# --- keys and small functions ------------------------------------------------


@query("F8", f"""
WITH {S.SEGMENTS}
SELECT doc_id, pos, sha256('v3||' || {S.strip('text')} || '||English||Korean||'
  || CASE WHEN doc_id % 2 = 0 THEN md5('a => b') ELSE '' END) AS cache_key FROM segs""")
def memo_keys(spark, sf):
    glossary = F.when(F.col("doc_id") % 2 == 0, "a => b").otherwise("")
    return doc_segments(spark, sf).select(
        "doc_id", "pos",
        memo_key(F.concat(F.lit(" "), F.col("text"), F.lit("\n")), F.lit("English "), F.lit(" Korean"),
                 glossary).alias("cache_key"),
    )


@query("F9 J9", """
SELECT doc_id, sha256(text || '|openai|m' || doc_id % 3) AS prompt_hash,
  md5(lang || '_ko_' || text) AS memory_key FROM documents""")
def prompt_hashes(spark, sf):
    model = F.concat(F.lit("m"), F.col("doc_id") % 3)
    return table(spark, sf, "documents").select(
        "doc_id", prompt_key(F.col("text"), F.lit("openai"), model).alias("prompt_hash"),
        F.md5(memory_key(F.col("text"), F.col("lang"), F.lit("ko"))).alias("memory_key"),
    )


@query("F25", """
SELECT p_partkey, '#' || lpad(lower(to_hex(p_partkey * 7919 % 16777216)), 6, '0') AS color,
  round((p_partkey * 7919 % 16777216) // 65536 / 255.0, 9)::DOUBLE AS r,
  round((p_partkey * 7919 % 16777216) // 256 % 256 / 255.0, 9)::DOUBLE AS g,
  round((p_partkey * 7919 % 16777216) % 256 / 255.0, 9)::DOUBLE AS b FROM part""")
def colors(spark, sf):
    rgb = F.col("p_partkey") * 7919 % 16777216
    named = table(spark, sf, "part").select("p_partkey", G.hex_color(rgb).alias("color"))
    parts = named.withColumn("p", G.color_parts(F.col("color")))
    return parts.select("p_partkey", "color", *[F.round(f"p.{c}", 9).alias(c) for c in "rgb"])


@query("F28", "SELECT doc_id, CAST(length(text) // 4 AS INTEGER) AS tokens FROM documents")
def token_estimates(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query("F31", f"WITH {S.SEGMENTS} SELECT doc_id, pos, '[모의 번역] ' || text AS translated FROM segs WHERE needs")
def mock_mapping(spark, sf):
    return doc_segments(spark, sf).where("needs").select(
        "doc_id", "pos", prompts.mock_mapping(F.col("text")).alias("translated")
    )


# --- tokens ------------------------------------------------------------------

def _skeleton_sql(expr: str) -> str:
    for _, pattern in K.PROTECTED_PATTERNS:
        expr = S.sub(expr, pattern.replace(r"\s<", K.SPACE_SET + "<"), "⟦PH⟧")
    return expr


@query("F4", f"WITH {MARKED_SQL} SELECT doc_id, {_skeleton_sql('text')} AS skeleton FROM marked")
def protect_literals(spark, sf):
    protect = tokens.protector()
    return marked_documents(spark, sf).select("doc_id", protect("text").alias("p")).select(
        "doc_id", F.regexp_replace("p.text", r"⟦PH\d+⟧", "⟦PH⟧").alias("skeleton")
    )


@query("F4", f"""
WITH RECURSIVE {MARKED_SQL}, {S.protected('marked', 'doc_id')}
SELECT doc_id, t AS protected, CAST(n AS INTEGER) AS tokens, array_to_string(raws, chr(1)) AS held FROM prot""")
def protected_texts(spark, sf):
    """Numbered tokens and what they stand for."""
    p = marked_documents(spark, sf).select("doc_id", tokens.protector()("text").alias("p"))
    return p.select(
        "doc_id", F.col("p.text").alias("protected"), F.size("p.held").alias("tokens"),
        F.array_join("p.held", "\x01").alias("held"),
    )


@query("F4 F5 O3", f"WITH {MARKED_SQL} SELECT doc_id, text AS restored, NULL::VARCHAR AS error, true AS sound FROM marked")
def protect_restore(spark, sf):
    protect = tokens.protector()
    p = marked_documents(spark, sf).select("doc_id", protect("text").alias("p"))
    stored = p.select("doc_id", "p.text", tokens.token_map("PH", F.col("p.held")).alias("m"), "p")
    back = stored.withColumn("r", tokens.restore("text", tokens.from_token_map(F.col("m")), "p.terms"))
    return back.select(
        "doc_id", F.col("r.text").alias("restored"), "r.error",
        tokens.token_error(F.col("p.text"), F.col("p.text")).isNull().alias("sound"),
    )


@query("F4 F5 O2", f"""
WITH {TERMS_SQL},
part_words AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part)
SELECT p_partkey, upper(p_name) AS restored, count(*) AS swapped
FROM part JOIN part_words USING (p_partkey) GROUP BY p_partkey, p_name""")
def protect_glossary(spark, sf):
    from folioflow.operators import glossary

    part = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("text"))
    terms = glossary_terms(spark, sf).withColumn("ord", F.col("source"))
    own = glossary.own_terms(glossary.contained_terms(part, terms, "p_partkey"), "p_partkey")
    p = part.join(own, "p_partkey", "left").withColumn("p", tokens.protect_with_terms("text", "terms"))
    back = p.withColumn("r", tokens.restore("p.text", "p.held", "p.terms"))
    return back.select(
        "p_partkey", F.col("r.text").alias("restored"),
        F.size("p.terms").cast("bigint").alias("swapped"),
    )


@query("A14 F6 U6", f"""
WITH {MARKED_SQL},
t AS (SELECT doc_id, doc_id % 5 AS n FROM marked)
SELECT doc_id, CASE WHEN n = 1 THEN '⟦PH0⟧' ELSE '' END AS missing,
  CASE WHEN n = 2 THEN '⟦PH1⟧' ELSE '' END AS duplicated,
  CASE WHEN n = 3 THEN '⟦PH9⟧,⟦GL7⟧' ELSE '' END AS hallucinated,
  CASE n WHEN 1 THEN 'missing ⟦PH0⟧' WHEN 2 THEN 'duplicated ⟦PH1⟧' WHEN 3 THEN 'hallucinated ⟦PH9⟧' END AS error
FROM t""")
def token_validation(spark, sf):
    m = marked_documents(spark, sf)
    original = F.concat(F.lit("⟦PH0⟧ ⟦PH1⟧ ⟦GL0⟧ "), F.col("text"))
    n = F.col("doc_id") % 5
    mapped = (
        F.when(n == 1, F.replace(original, F.lit("⟦PH0⟧"), F.lit("")))
        .when(n == 2, F.concat(original, F.lit("⟦PH1⟧")))
        .when(n == 3, F.concat(original, F.lit("⟦PH9⟧⟦GL7⟧"))).otherwise(original)
    )
    pairs = m.select("doc_id", original.alias("a"), mapped.alias("b"))
    faults = tokens.token_faults(F.col("a"), F.col("b"))
    return pairs.select(
        "doc_id", *[F.array_join(faults[f], ",").alias(f) for f in ("missing", "duplicated", "hallucinated")],
        tokens.token_error(F.col("a"), F.col("b")).alias("error"),
    )


@query("F7", f"""
WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text || ' [a](http://b c' WHEN 1 THEN text || ' ⟦PH3⟧'
  WHEN 2 THEN text || ' [a](http://b)' ELSE text END AS text FROM documents)
SELECT doc_id, nullif(regexp_extract(text, '⟦(?:PH|GL)[0-9]+⟧'), '') AS stray,
  {S.hit('text', K.OPEN_LINK)} AS open_link,
  (length(text) - length(replace(text, '*', ''))) % 2 = 1 AS odd_asterisks
FROM t""")
def finished_checks(spark, sf):
    n, t = F.col("doc_id") % 4, F.col("text")
    ended = (
        F.when(n == 0, F.concat(t, F.lit(" [a](http://b c"))).when(n == 1, F.concat(t, F.lit(" ⟦PH3⟧")))
        .when(n == 2, F.concat(t, F.lit(" [a](http://b)"))).otherwise(t)
    )
    return table(spark, sf, "documents").select("doc_id", ended.alias("text")).select(
        "doc_id", markup.stray_token(F.col("text")).alias("stray"),
        markup.has_open_link(F.col("text")).alias("open_link"),
        markup.odd_asterisks(F.col("text")).alias("odd_asterisks"),
    )


@query("F7", """
SELECT doc_id, CASE doc_id % 8 WHEN 1 THEN 'invalid json block' WHEN 3 THEN 'invalid xml block'
  WHEN 5 THEN 'invalid html block' END AS fault FROM documents""")
def fenced_blocks(spark, sf):
    """Each document's own length and key inside fenced JSON, XML and HTML of both kinds."""
    n = F.col("doc_id") % 8
    number = F.col("n_chars").cast("string")

    def fence(kind: str, *parts):
        return F.concat(F.col("text"), F.lit(f"\n```{kind}\n"), *parts, F.lit("\n```"))

    body = (
        F.when(n == 0, fence("json", F.lit('{"n": '), number, F.lit("}")))
        .when(n == 1, fence("json", F.lit('{"n": '), number))
        .when(n == 2, fence("xml", F.lit("<n>"), number, F.lit("</n>")))
        .when(n == 3, fence("xml", F.lit("<n>"), number, F.lit("</m>")))
        .when(n == 4, fence("html", F.lit("<p>"), number, F.lit("<br></p>")))
        .when(n == 5, fence("html", F.lit("<p><b>"), number, F.lit("</p></b>")))
        .otherwise(F.col("text"))
    )
    return table(spark, sf, "documents").select("doc_id", markup.fence_fault(body).alias("fault"))


@query("F7a")
def html_balance(spark, sf):
    return table(spark, sf, "pages").select("page_id", markup.html_fault("html").alias("fault"))


@query("F7a", """
SELECT page_id, CASE page_id % 5 WHEN 1 THEN '</p> without start' WHEN 2 THEN 'expected </p>, got </div>'
  WHEN 3 THEN 'unclosed ' || opened || ',div,b' WHEN 4 THEN 'expected </i>, got </b>'
  ELSE 'expected </b>, got </' || regexp_extract(split_part(html, '<b>', 2), '</([a-z0-9]+)>', 1) || '>' END AS fault
FROM (SELECT *, array_to_string(list_filter(['html', 'body', 'article', 'p'], lambda t:
  len(regexp_extract_all(whole, '<' || t || '[ >]')) > len(regexp_extract_all(whole, '</' || t || '>'))), ',') AS opened
  FROM (SELECT *, regexp_replace(split_part(html, '<b>', 1), '(?s)<script>.*?</script>', '', 'g') AS whole FROM pages))""")
def html_faults(spark, sf):
    """Faults planted before and behind each page's own markup; every fifth page shows the fault it came with.

    The pages hold one <b> that is never closed. What stands before it is sound but for the elements still open there.
    """
    html, kind = F.col("html"), F.col("page_id") % 5
    built = (
        F.when(kind == 1, F.concat(F.lit("</p>"), html)).when(kind == 2, F.concat(F.lit("<div><p></div>"), html))
        .when(kind == 3, F.concat(F.substring_index(html, "<b>", 1), F.lit("<div><b>")))
        .when(kind == 4, F.concat(F.lit("<b><i></b></i></b>"), html)).otherwise(html)
    )
    return table(spark, sf, "pages").select("page_id", markup.html_fault(built).alias("fault"))


@query("F4", "SELECT page_id, len(regexp_extract_all(html, '<[^>]+>')) AS tags FROM pages")
def html_tag_counts(spark, sf):
    """Literals of the tag kind per page."""
    return table(spark, sf, "pages").select(
        "page_id", F.regexp_count("html", F.lit("<[^>]+>")).cast("bigint").alias("tags")
    )


# --- answers -----------------------------------------------------------------

_ANSWER = f"""WITH {S.SEGMENTS}
SELECT doc_id, CAST(pos AS INTEGER) AS pos, seg_id AS segment_id, '[모의 번역] ' || text AS translated_text
FROM segs"""


def _answers(spark, sf):
    """One fenced model answer per document over all its segments."""
    d = table(spark, sf, "documents").select("doc_id", text.segment_lines(F.col("text")).alias("ls"))
    segs = F.transform("ls", lambda t, i: F.struct(
        segments.segment_id(F.floor(i / 10).cast("int"), i % 10).alias("seg_id"), t.alias("text")))
    raw = F.concat(F.lit("<think>{ hm }</think>\n"), mock_answer(segs))
    return d.select("doc_id", raw.alias("raw"))


@query("F10", _ANSWER)
def answers_strict(spark, sf):
    return _answers(spark, sf).select(
        "doc_id", F.posexplode(parse_strict(F.col("raw"))).alias("pos", "p")
    ).select("doc_id", "pos", "p.*")


@query("F10", _ANSWER)
def answers_recovered(spark, sf):
    """The same answers with their closing bracket lost: complete pairs are recovered."""
    broken = F.regexp_replace("raw", r"\]\}\z", "")
    return _answers(spark, sf).select("doc_id", parse_answer(broken).alias("a")).select(
        "doc_id", F.posexplode("a.pairs").alias("pos", "p")
    ).select("doc_id", "pos", "p.*")


# --- batching ----------------------------------------------------------------


@query("W1", f"""
WITH RECURSIVE {S.SEGMENTS}, {S.targets()}, {S.greedy('tgt', 'doc_id', 1500, 10)}
SELECT p.doc_id, t.pos, p.batch_id FROM packed p JOIN tgt t USING (doc_id, idx)""")
def batches_of_documents(spark, sf):
    """Greedy batches inside each document's row: no shuffle."""
    d = table(spark, sf, "documents").select("doc_id", text.segment_lines(F.col("text")).alias("ls"))
    all_segs = F.transform("ls", lambda t, i: F.struct(i.alias("pos"), t.alias("text")))
    d = d.select("doc_id", F.filter(all_segs, lambda s: text.has_letter(s["text"])).alias("targets"))
    cut = plan.document_batches(d)
    return cut.select("doc_id", "batch_id", F.explode("segments.pos").alias("pos")).select(
        "doc_id", "pos", F.col("batch_id").cast("bigint").alias("batch_id")
    )


@query("W1", f"""
WITH RECURSIVE {S.SEGMENTS}, {S.targets()}, {S.greedy('tgt', 'doc_id', 1500, 10)}
SELECT doc_id, batch_id, count(*) AS segments, CAST(sum(size) AS BIGINT) AS chars,
  min(pos) AS first_pos, max(pos) AS last_pos
FROM packed JOIN tgt USING (doc_id, idx) GROUP BY doc_id, batch_id""")
def batch_fill(spark, sf):
    """Fill of every batch, for segments in groups of any size."""
    targets = doc_segments(spark, sf).where("needs")
    numbers = plan.batched_work(targets)
    return batching.batch_summary(targets.join(numbers, ["doc_id", "pos"]), ["doc_id"])


_TALK_TGT = f"""{S.TALK},
tgt AS (
  SELECT conv_id, turn, sub, row_number() OVER (PARTITION BY conv_id ORDER BY turn, sub) - 1 AS idx,
    length(text) AS size, {S.label('text')} AS kind FROM talk WHERE {S.hit('text', K.LETTER)})"""


def _talk_batches(spark, sf, kind, chars, rows):
    t = blocked.with_block(talk(spark, sf).where("needs"), F.col("turn"))
    return batching.assign_batches(
        t, ["conv_id"], ["turn", "sub"], F.length("text"), kind, chars, rows
    )


@query("W1", f"""
WITH RECURSIVE {_TALK_TGT}, {S.greedy('tgt', 'conv_id', 1500, 10)}
SELECT p.conv_id, t.turn, CAST(t.sub AS INTEGER) AS sub, p.idx, p.batch_id
FROM packed p JOIN tgt t USING (conv_id, idx)""")
def batches_of_talk(spark, sf):
    """Greedy batches with label changes over conversations of any length."""
    return _talk_batches(spark, sf, text.is_label(F.col("text")), 1500, 10)


@query("W2", f"""
WITH RECURSIVE {_TALK_TGT}, plain AS (SELECT conv_id, turn, sub, idx, size, false AS kind FROM tgt),
{S.greedy('plain', 'conv_id', 450, 2)}
SELECT p.conv_id, t.turn, CAST(t.sub AS INTEGER) AS sub, p.idx, p.batch_id
FROM packed p JOIN plain t USING (conv_id, idx)""")
def local_chunks(spark, sf):
    chars, rows, _ = K.QUANT_PRESETS[2]
    return _talk_batches(spark, sf, F.lit(False), chars, rows)


@query("W3", f"""
WITH RECURSIVE t AS (
  SELECT doc_id, string_split_regex({S.strip('text')}, {S.quoted(K.SPACE + '+')}) AS ws
  FROM documents WHERE {S.strip('text')} <> ''),
w AS (SELECT doc_id, i, sum(length(w) // 4 + 1) OVER (PARTITION BY doc_id ORDER BY i) AS upto,
    length(w) // 4 + 1 AS cost
  FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM t)),
c AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS n, CAST(1 AS BIGINT) AS start, CAST(0 AS HUGEINT) AS before FROM t
  UNION ALL
  SELECT doc_id, n + 1, i, upto - cost FROM (
    SELECT w.doc_id, c.n, w.i, w.upto, w.cost,
      row_number() OVER (PARTITION BY w.doc_id ORDER BY w.i) AS rn
    FROM c JOIN w ON w.doc_id = c.doc_id AND w.i > c.start AND w.upto - c.before > 1000) WHERE rn = 1)
SELECT doc_id, CAST(doc_id % 3 + 1 AS BIGINT) AS page, 'p' || (doc_id % 3 + 1) || '_c' || n AS chunk_id,
  array_to_string(list_slice(ws, start,
    coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY n) - 1, len(ws))), ' ') AS chunk
FROM c JOIN t USING (doc_id)""")
def word_chunks(spark, sf):
    return batching.word_chunks(
        table(spark, sf, "documents"), "doc_id", F.col("text"), F.col("doc_id") % 3 + 1
    )


@query("W10", f"""
WITH {S.SEGMENTS},
r AS (SELECT doc_id, pos, text, sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - length(text) - 1 AS before
  FROM segs WHERE needs)
SELECT doc_id, {S.strip(f"left(string_agg(text || {NL}, '' ORDER BY pos), 1000)")} AS sample
FROM r WHERE before <= 1000 GROUP BY doc_id
UNION ALL SELECT doc_id, '' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM r)""")
def document_sample(spark, sf):
    ls = F.filter(text.segment_lines(F.col("text")), text.has_letter)
    return table(spark, sf, "documents").select("doc_id", context.sample(ls).alias("sample"))


@query("X1 W10", """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'UI' WHEN 1 THEN 'academic paper' ELSE 'default' END AS context
FROM documents""")
def context_category(spark, sf):
    n = F.col("doc_id") % 4
    reply = (
        F.when(n == 0, '```json\n{"context": "ui"}\n```').when(n == 1, '{"context": "Academic Paper"}')
        .when(n == 2, F.concat(F.lit('{"context": "'), F.col("lang"), F.lit('"}'))).otherwise("no json")
    )
    return table(spark, sf, "documents").select("doc_id", context.context_reply(reply).alias("context"))


# --- prompts -----------------------------------------------------------------

_TEMPLATE = (
    "From {{source_language}} to {{target_language}} ({{document_type}}, {{translation_style}}).\n"
    "{{terminology_policy}} {{glossary_data}} | {{document_title}} | {{document_domain}} | "
    "{{document_instructions}}\n{{prev_context}}\n{{text_segments}}"
)


def _prompt_sql() -> str:
    values = {
        "source_language": "lang", "target_language": "'Korean'", "document_type": "'report'",
        "translation_style": "'plain'", "terminology_policy": "'keep {{document_title}}'",
        "glossary_data": S.quoted(K.NO_GLOSSARY), "document_title": "'T' || doc_id",
        "document_domain": "source", "document_instructions": "'(none)'", "prev_context": "ctx",
        "text_segments": "block",
    }
    out = S.quoted(_TEMPLATE).replace("\n", "' || chr(10) || '")
    for marker in K.PROMPT_MARKERS:
        out = f"replace({out}, '{{{{{marker}}}}}', {values[marker]})"
    return out


_CONTEXT_SQL = f"""
pair AS (SELECT doc_id, idx, batch_id, left(text, 300) AS src, left('[모의 번역] ' || text, 300) AS dst
  FROM packed JOIN tgt USING (doc_id, idx)),
bs AS (SELECT doc_id, batch_id, min(idx) AS start FROM pair GROUP BY doc_id, batch_id),
chunks AS (
  SELECT b.doc_id, b.batch_id, p.idx, 'SOURCE: ' || src || chr(10) || 'TRANSLATION: ' || dst AS c,
    row_number() OVER (PARTITION BY b.doc_id, b.batch_id ORDER BY p.idx DESC) AS age
  FROM bs b JOIN pair p ON p.doc_id = b.doc_id AND p.idx < b.start AND p.idx >= b.start - 12),
fit AS (SELECT *, sum(length(c)) OVER (PARTITION BY doc_id, batch_id ORDER BY age) AS total FROM chunks),
ctx AS (
  SELECT doc_id, batch_id, string_agg(c, chr(10) || '---' || chr(10) ORDER BY idx) AS ctx
  FROM fit WHERE age = 1 OR total <= 1500 GROUP BY doc_id, batch_id)"""


def _context_batches(spark, sf):
    """Batches with their rolling context, built inside each document's row."""
    d = table(spark, sf, "documents").select(
        "doc_id", "lang", "source", text.segment_lines(F.col("text")).alias("ls"))
    all_segs = F.transform("ls", lambda t, i: F.struct(
        segments.segment_id(F.floor(i / 10).cast("int"), i % 10).alias("seg_id"), t.alias("text")))
    d = d.select("doc_id", "lang", "source",
                 F.filter(all_segs, lambda s: text.has_letter(s["text"])).alias("targets"))
    starts = batching.starts_in_row()(
        F.transform("targets", lambda s: F.length(s["text"])),
        F.transform("targets", lambda s: text.is_label(s["text"])),
    )
    d = d.withColumn("_starts", starts)
    pairs = F.transform("targets", lambda s: F.struct(
        s["text"].alias("source"), prompts.mock_mapping(s["text"]).alias("target")))
    cut = d.withColumn("_pairs", pairs)
    with_context = F.transform(
        F.arrays_zip("_starts", batching.slices(F.col("targets"), F.col("_starts")).alias("segs")),
        lambda z: F.struct(
            z["segs"].alias("segments"),
            prompts.context_block(context.rolling_pairs(F.col("_pairs"), z["_starts"])).alias("ctx"),
        ),
    )
    return cut.select("doc_id", "lang", "source", F.posexplode(with_context).alias("batch_id", "b")).select(
        "doc_id", "lang", "source", F.col("batch_id").cast("bigint").alias("batch_id"), "b.segments", "b.ctx")


@query("W5", f"""
WITH RECURSIVE {S.SEGMENTS}, {S.targets()}, {S.greedy('tgt', 'doc_id', 1500, 10)}, {_CONTEXT_SQL}
SELECT doc_id, batch_id, coalesce(ctx, '(none)') AS context FROM bs LEFT JOIN ctx USING (doc_id, batch_id)""")
def rolling_context(spark, sf):
    return _context_batches(spark, sf).select("doc_id", "batch_id", F.col("ctx").alias("context"))


@query("F22 F23", f"""
WITH RECURSIVE {S.SEGMENTS}, {S.targets()}, {S.greedy('tgt', 'doc_id', 1500, 10)}, {_CONTEXT_SQL},
blocks AS (
  SELECT doc_id, batch_id, string_agg('SEGMENT_ID: ' || seg_id || chr(10) || 'TEXT:' || chr(10) || s.text,
    chr(10) || chr(10) || '-----' || chr(10) || chr(10) ORDER BY idx) AS block
  FROM packed JOIN tgt t USING (doc_id, idx) JOIN segs s ON s.doc_id = packed.doc_id AND s.pos = t.pos
  GROUP BY doc_id, batch_id),
j AS (SELECT b.doc_id, b.batch_id, block, coalesce(ctx, '(none)') AS ctx, lang, source FROM blocks b
  LEFT JOIN ctx c ON c.doc_id = b.doc_id AND c.batch_id = b.batch_id
  JOIN documents d ON d.doc_id = b.doc_id)
SELECT doc_id, batch_id, {_prompt_sql()} AS prompt FROM j""")
def batch_prompts(spark, sf):
    settings = {
        "doc_type": F.lit("report"), "style": F.lit("plain"),
        "terminology": F.lit("keep {{document_title}}"),
        "title": F.concat(F.lit("T"), F.col("doc_id")), "domain": F.col("source"),
        "instructions": F.lit(""),
    }
    return _context_batches(spark, sf).select(
        "doc_id", "batch_id",
        prompts.user_prompt(
            F.lit(_TEMPLATE), source_lang=F.col("lang"), target_lang=F.lit("Korean"), glossary=F.lit(""),
            context=F.col("ctx"), segments=F.col("segments"), settings=settings,
        ).alias("prompt"),
    )


@query("F24", """
SELECT doc_id, 'Translate ' || text || ' from ' || lang || ' cost $ and $none ' || lang || 'x' AS prompt
FROM documents""")
def template_prompts(spark, sf):
    template = F.lit("Translate ${source_text} from $source_lang cost $$ and $none ${source_lang}x")
    return table(spark, sf, "documents").select(
        "doc_id",
        prompts.substitute(
            template, {"source_text": F.col("text"), "source_lang": F.col("lang")}
        ).alias("prompt"),
    )
