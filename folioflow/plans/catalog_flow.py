"""End-to-end queries: mapping, reconciling, memo runs and streaming runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow import constants as K
from folioflow.functions.prompts import mock_mapping
from folioflow.operators import memo
from folioflow.operators.reconcile import OversizeError, map_batches, reconcile, with_fallback
from folioflow.plans import sqlparts as S
from folioflow.plans import translate as plan
from folioflow.plans.inputs import MARKED_SQL, marked_documents, table
from folioflow.plans.registry import query
from folioflow.session import materialize, shuffles_freed, work_path
from folioflow.streaming import jobs

_MOCK_SEGMENTS = f"WITH {S.SEGMENTS} SELECT doc_id, pos, '[모의 번역] ' || text AS translated FROM segs WHERE needs"


@query("S1 P1 P2 W1 A7", f"""
WITH RECURSIVE {S.SEGMENTS}, {S.targets()}, {S.greedy('tgt', 'doc_id', 1500, 10)},
b AS (SELECT doc_id, batch_id, count(*) AS n, sum(size) AS chars FROM packed JOIN tgt USING (doc_id, idx) GROUP BY ALL)
SELECT d.doc_id, count(n) AS batches, CAST(coalesce(sum(n), 0) AS BIGINT) AS segments,
  CAST(coalesce(sum(chars), 0) AS BIGINT) AS chars, CAST(coalesce(max(chars), 0) AS INTEGER) AS fullest,
  coalesce(round(avg(chars) / 1500, 6), 0.0) AS mean_fill
FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id GROUP BY d.doc_id""")
def corpus_calls(spark, sf):
    """How many model calls does every document need, and how full are they?"""
    from folioflow.functions.text import has_letter, is_label, segment_lines
    from folioflow.operators import batching

    lines = F.filter(segment_lines(F.col("text")), has_letter)
    sized = table(spark, sf, "documents").select("doc_id", lines.alias("_t")).select(
        "doc_id", F.transform("_t", F.length).alias("_sizes"), F.transform("_t", is_label).alias("_kinds")
    )
    cut = sized.withColumn("_starts", batching.starts_in_row()("_sizes", "_kinds"))
    fills = F.transform(
        batching.slices(F.col("_sizes"), F.col("_starts")),
        lambda b: F.aggregate(b, F.lit(0), lambda a, n: a + n),
    )
    total = F.aggregate("_fills", F.lit(0).cast("bigint"), lambda a, n: a + n)
    mean = F.when(F.size("_fills") > 0, total / F.size("_fills") / K.BATCH_CHARS)
    return cut.withColumn("_fills", fills).select(
        "doc_id", F.size("_fills").cast("bigint").alias("batches"),
        F.size("_sizes").cast("bigint").alias("segments"), total.alias("chars"),
        F.coalesce(F.array_max("_fills"), F.lit(0)).alias("fullest"),
        F.coalesce(F.round(mean, 6), F.lit(0.0)).alias("mean_fill"),
    )


@query("J3 M3 X3", f"""
WITH RECURSIVE {S.SEGMENTS}, {S.targets()}, {S.greedy('tgt', 'doc_id', 1500, 10)},
r AS (SELECT doc_id, pos, batch_id, text, (doc_id + batch_id) % 4 AS n,
    pos = min(pos) OVER w AS is_first, pos = max(pos) OVER w AS is_last
  FROM packed JOIN tgt USING (doc_id, idx) WINDOW w AS (PARTITION BY doc_id, batch_id))
SELECT doc_id, pos, CASE WHEN n = 2 AND is_first THEN text WHEN n = 3 AND is_last THEN 'dup ' || text
  ELSE '[모의 번역] ' || text END AS translated, n = 2 AND is_first AS failed
FROM r""")
def reconciled_batches(spark, sf):
    """Answers in order, with swapped ids, with a gap and with a repeated id."""
    targets = plan.protected_documents(table(spark, sf, "documents")).withColumn(
        "targets", F.transform("targets", lambda s: s.withField("text", s["source"]))
    )
    batches = plan.document_batches(targets)
    pair = F.transform("segments", lambda s: F.struct(
        s["seg_id"].alias("segment_id"), mock_mapping(s["text"]).alias("translated_text")))
    swapped = F.zip_with(
        F.reverse(F.transform("segments", lambda s: s["seg_id"])), F.col("_pairs"),
        lambda i, p: F.struct(i.alias("segment_id"), p["translated_text"].alias("translated_text")),
    )
    last = F.element_at("segments", -1)
    repeated = F.concat(F.col("_pairs"), F.array(F.struct(
        last["seg_id"].alias("segment_id"), F.concat(F.lit("dup "), last["text"]).alias("translated_text"))))
    n = (F.col("doc_id") + F.col("batch_id")) % 4
    answers = (
        F.when(n == 0, F.col("_pairs")).when(n == 1, swapped)
        .when(n == 2, F.slice("_pairs", 2, F.size("_pairs"))).otherwise(repeated)
    )
    answered = batches.withColumn("_pairs", pair).withColumn("pairs", answers)
    matched = answered.withColumn("_m", reconcile(F.col("segments"), F.col("pairs"), F.lit("French")))
    rows = matched.select("doc_id", F.explode(F.arrays_zip("segments", "_m")).alias("z")).select(
        "doc_id", "z.segments.pos", "z.segments.text", F.col("z._m.translated").alias("translated")
    )
    return rows.transform(with_fallback).select("doc_id", "pos", "translated", "failed")


def _limited_mapper(limit: int):
    """A mapper that refuses requests over a number of characters."""
    import json

    def ask(segments):
        if sum(len(s["text"]) for s in segments) > limit:
            raise OversizeError
        return json.dumps({"translations": [
            {"segment_id": s["seg_id"], "translated_text": K.MOCK_PREFIX + s["text"]} for s in segments
        ]})

    return ask


@query("X1 W14 W2", f"""
WITH {S.SEGMENTS}
SELECT doc_id, pos, CASE WHEN length(text) > 900 THEN text ELSE '[모의 번역] ' || text END AS translated,
  length(text) > 900 AS failed
FROM segs WHERE needs""")
def halved_batches(spark, sf):
    """A Python mapper with a size limit: oversize batches are halved, hopeless rows kept as they are."""
    targets = plan.protected_documents(table(spark, sf, "documents")).withColumn(
        "targets", F.transform("targets", lambda s: s.withField("text", s["source"]))
    )
    batches = plan.document_batches(targets)
    answered = map_batches(batches, lambda: _limited_mapper(900), ["doc_id", "batch_id"])
    matched = answered.withColumn("_m", reconcile(F.col("segments"), F.col("pairs"), F.lit("Korean")))
    rows = matched.select("doc_id", F.explode(F.arrays_zip("segments", "_m")).alias("z")).select(
        "doc_id", "z.segments.pos", "z.segments.text", F.col("z._m.translated").alias("translated")
    )
    return with_fallback(rows).select("doc_id", "pos", "translated", "failed")


def _translated_sql(head: str, lines: str) -> str:
    """Protect, prefix, normalise, restore and check every target line on its own."""
    keys = "doc_id, pos, seg_id"
    mapped = S.normalized("'[모의 번역] ' || t")
    return f"""
WITH RECURSIVE {head}{lines},
tsegs AS (
  SELECT doc_id, pos, printf('page_%03d_block_%03d', pos // 10 + 1, pos % 10) AS seg_id, text
  FROM ls WHERE {S.hit('text', K.LETTER)}),
{S.protected('tsegs', keys)},
{S.restored('prot', keys, mapped)}
SELECT {keys}, CASE WHEN {S.hit('z', K.OPEN_LINK)} THEN src ELSE z END AS translated,
  {S.hit('z', K.OPEN_LINK)} AS failed FROM back"""


@query("F4 F5 F6 F7 F2 J3 W1 X3", _translated_sql("", S.lines("documents", "doc_id")))
def translated_documents(spark, sf):
    """The whole document plan with the default mapper, in one pass without a shuffle."""
    return plan.translate(table(spark, sf, "documents")).select(
        "doc_id", F.col("pos").cast("int").alias("pos"), "seg_id", "translated", "failed"
    )


@query("X7", f"""
WITH {S.SEGMENTS}
SELECT doc_id, pos, '[모의 번역] ' || text AS translated FROM segs WHERE needs""")
def translated_without_steps(spark, sf):
    """The plan with placeholders, validation and style switched off."""
    bare = plan.Options(glossary=False, placeholders=False, validation=False, style=False)
    return plan.translate(table(spark, sf, "documents"), terms={"a": "b"}, options=bare).select(
        "doc_id", F.col("pos").cast("int").alias("pos"), "translated"
    )


def _length_classifier():
    def ask(text: str) -> str:
        return '{"context": "Report"}' if len(text) > 500 else '{"context": "tweet"}'

    return ask


@query("X1 W10", f"""
WITH {S.SEGMENTS},
n AS (SELECT doc_id, sum(length(text) + 1) - 1 AS n FROM segs WHERE needs GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN n.n IS NULL THEN 'default' WHEN n.n > 500 THEN 'report' ELSE 'tweet' END AS context
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id""")
def document_contexts(spark, sf):
    return plan.document_contexts(table(spark, sf, "documents"), _length_classifier)


@query("F4 F5 F6 F7 F2 J3 W1 X1", _translated_sql(MARKED_SQL + ",", S.lines("marked", "doc_id")))
def translated_marked_documents(spark, sf):
    """The same with documents full of literals and a Python mapper."""
    done = plan.translate(
        marked_documents(spark, sf), make_mapper=lambda: _limited_mapper(100_000)
    )
    return done.select("doc_id", F.col("pos").cast("int").alias("pos"), "seg_id", "translated", "failed")


@query("J2 M2 D3", _MOCK_SEGMENTS)
def memo_run(spark, sf):
    """Map each distinct text once, store it, and give every copy its result."""
    docs = table(spark, sf, "documents")
    path = work_path(spark, "memo")
    memo.create_empty(spark, path)
    segments = materialize(plan.keyed_segments(docs, "English", "Korean"), "segments")
    work = plan.pending_segments(segments, memo.stored_rows(spark, path))
    memo.append(plan.mock_results(work, "English", "Korean"), path, 0)
    done = plan.finish_segments_from(segments, memo.load(spark, path))
    return done.select("doc_id", "pos", "translated")


def _moody_mapper():
    """Refuses large requests, fails on some first attempts, and leaves rows out of others."""
    import json
    import zlib

    def answer(segments):
        if len(segments) > 6:
            raise OversizeError("more than six")
        first = segments[0]["attempt"] == 0
        if first and zlib.crc32(segments[0]["text"].encode()) % 7 == 0:
            raise ValueError("no answer")
        kept = [s for s in segments if not (first and zlib.crc32(s["text"].encode()) % 5 == 0)]
        return json.dumps({"translations": [
            {"segment_id": s["seg_id"], "translated_text": "[모의 번역] " + s["text"]} for s in kept]})

    return answer


def _refusing_mapper():
    import json

    def answer(segments):
        if segments[0]["doc_id"] % 4 == 1:
            raise ValueError("refused")
        return json.dumps({"translations": [{"segment_id": s["seg_id"], "translated_text": "[모의 번역] " + s["text"]} for s in segments]})

    return answer


@query("X1 J2 J3 M2 D3", f"""
WITH {S.SEGMENTS}
SELECT doc_id, pos, '[모의 번역] ' || text AS translated, NULL::VARCHAR AS error, false AS failed FROM segs WHERE needs""")
def memo_mapped_run(spark, sf):
    """A mapper that omits, fails and refuses; missing work is asked again, and a second run has none."""
    docs = table(spark, sf, "documents")
    path = work_path(spark, "memo")
    memo.create_empty(spark, path)
    plain = plan.Options(placeholders=False, validation=False)
    done = plan.translate_through_memo(docs, path, _moody_mapper, "English", "Korean", options=plain, with_text=False)
    return done.select("doc_id", "pos", "translated", "error", "failed")


@query("D3 J2", f"""
WITH {S.SEGMENTS}
SELECT count(DISTINCT text) AS first_calls, 0 AS second_calls FROM segs WHERE needs""")
def memo_calls(spark, sf):
    """Mapper calls of a first run and of its repetition."""
    docs = table(spark, sf, "documents")
    path = work_path(spark, "memo")
    memo.create_empty(spark, path)
    first = plan.pending(docs, memo.stored_rows(spark, path), "English", "Korean")
    memo.append(plan.mock_results(first, "English", "Korean"), path, 0)
    second = plan.pending(docs, memo.stored_rows(spark, path), "English", "Korean")
    return memo.load(spark, path).agg(F.count("*").alias("first_calls")).join(
        F.broadcast(second.agg(F.count("*").alias("second_calls")))
    )


# --- streaming ---------------------------------------------------------------


def _stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    return jobs.document_stream(spark, sf, "documents.parquet", schema)


@query("S1 R3 R4 R6", f"WITH {S.SEGMENTS} SELECT doc_id, pos, seg_id, text, needs FROM segs")
def stream_segments(spark, sf):
    """Segments of arriving documents; the second start resumes and finds nothing new."""
    out, checkpoint = work_path(spark, "segments"), work_path(spark, "checkpoint")
    for _ in range(2):
        jobs.run_available(jobs.segment_stream(_stream(spark, sf)), out, checkpoint)
    return spark.read.parquet(out).select("doc_id", "pos", "seg_id", "text", "needs")


@query("R1 R2", f"""
SELECT doc_id AS request_id, {S.strip(S.sub('text', S.K.SPACE + '+', ' '))} AS text FROM documents""")
def stream_tokens(spark, sf):
    """Token streams of many requests, stored as they arrive and joined per request."""
    out, checkpoint = work_path(spark, "tokens"), work_path(spark, "checkpoint")
    jobs.run_available(jobs.token_stream(_stream(spark, sf)), out, checkpoint)
    return jobs.concat_tokens(spark.read.parquet(out), " ")


@query("R4 M2 J2", f"""
WITH {S.SEGMENTS}
SELECT DISTINCT text AS source_text, '[모의 번역] ' || text AS translated_text FROM segs WHERE needs""")
def stream_memo(spark, sf):
    """A memo filled by micro-batches that skip finished texts; restarted once."""
    path, checkpoint = work_path(spark, "memo"), work_path(spark, "checkpoint")
    memo.create_empty(spark, path)
    for _ in range(2):
        jobs.run_memo(_stream(spark, sf), path, checkpoint, "English", "Korean")
    return memo.load(spark, path).select("source_text", "translated_text")


@query("R1 R2 R3", f"""
SELECT doc_id AS request_id, {S.strip(S.sub('text', S.K.SPACE + '+', ' '))} AS text, true AS complete
FROM documents WHERE {S.strip('text')} <> ''""")
def stream_answers(spark, sf):
    """Tokens of many requests out of order over several files, some twice; stopped after the first files and restarted."""
    from folioflow.streaming.answers import live_answers

    events, out, checkpoint = (work_path(spark, n) for n in ("events", "answers", "checkpoint"))
    tokens = jobs.token_stream(table(spark, sf, "documents"), ends=True)  # the end mark is part of what a service sends
    twice = tokens.withColumn("copy", F.explode(F.when(F.col("pos") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    files = spark.sparkContext.defaultParallelism  # of one trigger, so that all cores write and read
    share = F.pmod(F.xxhash64("pos", "copy"), F.lit(4))
    dealt = twice.repartition(4 * files, share, "request_id").drop("copy")
    told = dealt.withColumn("at", F.lit("2024-01-01 00:00:00").cast("timestamp"))

    def start():
        stream = spark.readStream.schema(told.schema).option("maxFilesPerTrigger", files).parquet(events)
        return live_answers(stream)

    with shuffles_freed(spark):
        told.write.option("compression", "zstd").parquet(events)
        jobs.run_until(start(), out, checkpoint, lambda q: any(p.numInputRows for p in q.recentProgress))
        jobs.run_available(start(), out, checkpoint)
    return spark.read.parquet(out).select("request_id", "text", "complete")


@query("R7 F33", """
SELECT user_id, event_id, CAST(event_id % 50 AS INTEGER) AS batch, 50 AS batches, (event_id % 50) * 2.0::DOUBLE AS percent FROM events""")
def log_progress(spark, sf):
    """Progress lines of every user's log, tailed while the logs grow: half of the events, then the rest."""
    from folioflow.functions.services import progress_line
    from folioflow.streaming import logs

    logs.register(spark)
    n = F.col("event_id")
    said = F.concat(n, F.lit("   [진행] batch="), n % 50, F.lit("/50 pages=1/9 pct="), (n % 50) * 2, F.lit(".0"))
    lines = table(spark, sf, "events").select("event_id", F.concat(F.lit("user_id="), "user_id", F.lit(" "), said).alias("value"))
    folder, out, checkpoint = (work_path(spark, name) for name in ("logs", "log-lines", "checkpoint"))
    for half in (0, 1):
        lines.where(n % 2 == half).select("value").write.mode("append").text(folder)
        stream = spark.readStream.format("log_tail").option("suffix", ".txt").load(folder)
        jobs.run_tail(stream, out, checkpoint)
    read = spark.read.schema("file string, offset long, line string").parquet(out)
    p = progress_line(F.regexp_replace("line", r"\Auser_id=\d+ \d+ ", "")).alias("p")
    return read.select(F.regexp_extract("line", r"user_id=(\d+)", 1).cast("long").alias("user_id"),
                       F.regexp_extract("line", r"user_id=\d+ (\d+)", 1).cast("long").alias("event_id"), p).select(
        "user_id", "event_id", "p.batch", "p.batches", "p.percent")


@query("A7 A10 W9", f"""
WITH {S.SEGMENTS}
SELECT count(*) AS segments, count(*) FILTER (needs) AS targets, count(*) FILTER (NOT needs) AS skipped,
  CAST(coalesce(sum(length(text)) FILTER (needs), 0) AS BIGINT) AS target_chars,
  count(*) FILTER (needs AND doc_id % 4 <> 1) AS translated, count(*) FILTER (needs AND doc_id % 4 = 1) AS failed FROM segs""")
def observed_run(spark, sf):
    """The summary of a run, observed while its one scan was written; a mapper refuses every fourth document."""
    docs = table(spark, sf, "documents")
    metrics = plan.RunMetrics()
    done = plan.translate(docs, make_mapper=_refusing_mapper, metrics=metrics, keep=["doc_id"])
    done.write.parquet(work_path(spark, "observed"))
    return metrics.frame(spark)


def _prompted_mapper():
    import json

    def answer(request):
        told, prompt = len(request["context"]), request["prompt"]
        assert prompt.count("SEGMENT_ID: ") == len(request["segments"]) and ("SOURCE: " in prompt) == (told > 0)
        terms = "|".join(line.split(" => ")[0] for line in request["glossary"])
        return json.dumps({"translations": [
            {"segment_id": s["seg_id"], "translated_text": f"[모의 번역] {told} {terms} {s['text']}"} for s in request["segments"]]})

    return answer


@query("X1 W5 F22 F23", f"""
WITH RECURSIVE {S.SEGMENTS}, {S.targets()}, {S.greedy('tgt', 'doc_id', 1500, 10)},
b AS (SELECT doc_id, batch_id, least(min(idx), 12) AS told, string_agg(text, chr(10) ORDER BY idx) AS whole
  FROM packed JOIN tgt USING (doc_id, idx) GROUP BY doc_id, batch_id),
g AS (SELECT *, array_to_string(list_filter(['than', 'elle', 'en'], lambda t: contains(whole, t)), '|') AS terms FROM b)
SELECT doc_id, batch_id, pos, '[모의 번역] ' || told || ' ' || terms || ' ' || text AS translated, false AS failed
FROM packed JOIN tgt USING (doc_id, idx) JOIN g USING (doc_id, batch_id)""")
def prompted_documents(spark, sf):
    """A mapper that answers with what it was shown: number of context pairs, terms of the batch, text."""
    from folioflow.plans.prompted import Prompting, translate_prompted

    settings = Prompting("{{prev_context}}\n#\n{{glossary_data}}\n#\n{{text_segments}}")
    done = translate_prompted(
        table(spark, sf, "documents"), _prompted_mapper, settings, {"en": "e", "than": "t", "elle": "l"},
        options=plan.Options(placeholders=False, validation=False))
    return done.select("doc_id", F.col("batch_id").cast("bigint").alias("batch_id"), F.col("pos").cast("int").alias("pos"), "translated", "failed")
