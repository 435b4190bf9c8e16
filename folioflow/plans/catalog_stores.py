"""Queries over glossaries, interchange files, memo tables, histories and queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow import constants as K
from folioflow.functions.keys import memo_key, memory_key
from folioflow.operators import glossary, memo, reconcile, tasks
from folioflow.operators.segments import scan
from folioflow.plans import sqlparts as S
from folioflow.plans.inputs import STATUS_SQL, TERMS_SQL, glossary_terms, page_status, table
from folioflow.plans.inputs import segments as doc_segments
from folioflow.plans.registry import query
from folioflow.session import work_path
from folioflow.sources import files
from folioflow.sources import glossary as glossary_source

_FIXED_TIME = "2024-01-15 00:00:00"
_MICROS = "yyyy-MM-dd HH:mm:ss.SSSSSS"  # wall-clock text, whatever the session's zone


# --- glossaries --------------------------------------------------------------


@query("S3a", """
WITH l AS (SELECT p_partkey, p_partkey % 5 AS n, p_name, p_type FROM part),
e AS (SELECT p_partkey AS ord, CASE n WHEN 0 THEN p_name WHEN 1 THEN p_name || p_partkey WHEN 4 THEN p_name || ', more' END AS source,
  CASE n WHEN 0 THEN p_type || ', x' WHEN 1 THEN p_type || ', => y' WHEN 4 THEN p_type || ' => z' END AS target
  FROM l WHERE n IN (0, 1, 4))
SELECT source, arg_max(target, ord) AS target, min(ord) AS ord FROM e GROUP BY source""")
def glossary_lines(spark, sf):
    n = F.col("p_partkey") % 5
    line = (
        F.when(n == 0, F.concat(F.lit("  "), F.col("p_name"), F.lit(" => "), F.col("p_type"), F.lit(", x ")))
        .when(n == 1, F.concat(F.col("p_name"), F.col("p_partkey"), F.lit("=>"), F.col("p_type"), F.lit(", => y")))
        .when(n == 2, F.concat(F.lit(" # "), F.col("p_name"), F.lit(" => c")))
        .when(n == 3, F.col("p_name"))
        .otherwise(F.concat(F.col("p_name"), F.lit(", more => "), F.col("p_type"), F.lit(" => z")))
    )
    rows = table(spark, sf, "part").select("p_partkey", line.alias("line"))
    return glossary_source.from_lines(rows, "line", "p_partkey").select("source", "target", "ord")


def _profiled(spark, sf):
    p = table(spark, sf, "part")
    return p.select(
        F.when(F.col("p_partkey") % 3 > 0, F.col("p_brand")).alias("profile"),
        F.concat("p_name", F.lit(" "), "p_partkey").alias("source"), F.col("p_type").alias("target"),
    )


_PROFILED = """
t AS (SELECT CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS profile, p_name || ' ' || p_partkey AS source,
  p_type AS target FROM part), lowest AS (SELECT min(p_brand) AS b FROM part)"""


@query("S3c", f"""
WITH {_PROFILED}
SELECT 'named' AS pick, source, target FROM t, lowest WHERE profile = b
UNION ALL SELECT 'absent', source, target FROM t WHERE profile IS NULL""")
def glossary_profiles(spark, sf):
    t = _profiled(spark, sf)
    brand = table(spark, sf, "part").agg(F.min("p_brand")).first()[0]
    named = glossary.select_profile(t, brand).withColumn("pick", F.lit("named"))
    absent = glossary.select_profile(t, "no such profile").withColumn("pick", F.lit("absent"))
    return named.unionByName(absent)


@query("S3 S3b", """
SELECT p_size, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS profile, p_name || ' ' || p_partkey AS source, p_type AS target
FROM part""")
def glossary_documents(spark, sf):
    """JSON glossaries, one per part size, with flat and profiled entries, read back."""
    p = table(spark, sf, "part").select(
        "p_size", "p_brand", F.col("p_partkey") % 2 == 0,
        F.concat("p_name", F.lit(" "), "p_partkey").alias("source"), "p_type",
    ).toDF("p_size", "p_brand", "nested", "source", "target")
    nested = p.where("nested").groupBy("p_size", "p_brand").agg(
        F.map_from_entries(F.collect_list(F.struct("source", "target"))).alias("m")
    ).select("p_size", F.concat(
        F.to_json(F.create_map(F.col("p_brand"), F.col("m")))).alias("j"))
    flat = p.where(~F.col("nested")).groupBy("p_size").agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("source", "target")))).alias("j")
    )
    files_ = nested.unionByName(flat)
    kinds = [
        glossary_source.from_documents(part, "j", kind).select("profile", "source", "target")
        for part, kind in ((files_.where(F.col("p_size") % 2 == 0), "json"),
                           (files_.where(F.col("p_size") % 2 == 1), "yaml"))
    ]
    sizes = p.select("p_size", "source").distinct()
    return kinds[0].unionByName(kinds[1]).join(sizes, "source").select(
        "p_size", "profile", "source", "target"
    )


@query("S4 O2", f"""
WITH {TERMS_SQL}
SELECT source || ' => ' || target AS line, length(source)::INTEGER AS n FROM terms""")
def glossary_rendered(spark, sf):
    return glossary.as_lines(glossary_terms(spark, sf)).select("line", F.length("source").alias("n"))


_CONTAINED = f"""
WITH {TERMS_SQL}
SELECT p_partkey, source, target FROM part JOIN terms ON contains(p_name || ' ' || p_type, source)"""


def _part_texts(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", F.concat("p_name", F.lit(" "), "p_type").alias("text")
    )


@query("J4", _CONTAINED)
def contained_terms(spark, sf):
    return glossary.contained_terms(_part_texts(spark, sf), glossary_terms(spark, sf), "p_partkey")


@query("J4", _CONTAINED)
def contained_terms_large(spark, sf):
    """The same plan under its older name; one plan serves glossaries of any size."""
    return glossary.contained_terms(_part_texts(spark, sf), glossary_terms(spark, sf), "p_partkey")


# --- interchange -------------------------------------------------------------


@query("S5 S6", f"""
WITH {S.SEGMENTS}
SELECT doc_id, seg_id, '[모의 번역] ' || text AS translated FROM segs WHERE needs""")
def export_import(spark, sf):
    """Export every document to interchange JSON and read it back."""
    mapped = doc_segments(spark, sf).withColumn("translated", F.concat(F.lit(K.MOCK_PREFIX), F.col("text")))
    out = files.export_documents(reconcile.export_pairs(mapped, "doc_id"), "doc_id")
    return files.import_documents(out, "doc_id").select("doc_id", "seg_id", "translated")


@query("J1 S6", f"""
WITH {S.SEGMENTS}
SELECT doc_id, pos, CASE WHEN NOT needs THEN 'old' WHEN (doc_id + pos) % 4 = 0 THEN 'a ' || text
  WHEN (doc_id + pos) % 4 = 1 THEN 'b ' || text ELSE 'old' END AS translated
FROM segs""")
def imported_pairs(spark, sf):
    s = doc_segments(spark, sf).withColumn("translated", F.lit("old"))
    n = (F.col("doc_id") + F.col("pos")) % 4

    def answer(at: int, prefix: str):
        return F.struct(F.lit(at).alias("pos"), F.concat(F.lit(prefix), F.col("text")).alias("t"))

    blank = F.struct(F.lit(0).alias("pos"), F.lit("").alias("t"))
    answers = (
        F.when(n == 0, F.array(answer(0, "a "))).when(n == 1, F.array(answer(0, "a "), answer(1, "b ")))
        .when(n == 2, F.array(blank))
    )
    pairs = s.select("doc_id", "seg_id", F.explode(answers).alias("a")).select(
        "doc_id", "seg_id", "a.pos", F.col("a.t").alias("translated")
    )
    return reconcile.import_pairs(s, pairs, ["doc_id", "seg_id"]).select("doc_id", "pos", "translated")


@query("S7", "SELECT doc_id, text AS decoded FROM documents")
def decoded_texts(spark, sf):
    """Texts in four encodings with and without byte order marks, decoded again."""
    n = F.col("doc_id") % 4
    raw = (
        F.when(n == 0, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE")))
        .when(n == 1, F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "UTF-16BE")))
        .when(n == 2, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8")))
        .otherwise(F.encode("text", "UTF-8"))
    )
    return table(spark, sf, "documents").select("doc_id", files.decode(raw).alias("decoded"))


@query("S5 S15 X5", f"""
WITH {S.SEGMENTS}
SELECT CAST(doc_id AS VARCHAR) AS doc_id, seg_id AS segment_id, CAST(page + 1 AS INTEGER) AS page, text AS source,
  '[모의 번역] ' || text AS translated FROM segs WHERE needs""")
def interchange_source(spark, sf):
    """Mapped segments through the interchange data source: half of them written, replaced, the rest appended, all read back."""
    from folioflow.sources import interchange

    interchange.register(spark)
    mapped = doc_segments(spark, sf).withColumn("translated", F.concat(F.lit(K.MOCK_PREFIX), F.col("text")))
    rows = reconcile.export_pairs(mapped, "doc_id").select(
        F.col("doc_id").cast("string").alias("doc_id"), "segment_id", F.col("page").cast("int").alias("page"), "source", "translated")
    path, even = work_path(spark, "interchange"), F.col("doc_id").cast("long") % 2 == 0
    rows.where(even).write.format("interchange").mode("append").save(path)
    rows.where(even).write.format("interchange").mode("overwrite").save(path)
    rows.where(~even).write.format("interchange").mode("append").save(path)
    return spark.read.format("interchange").load(path)


_SPOKEN = """'[모의 번역] ' || text || ', "' || seg_id || '"' || chr(10) || 'end,' """


_SPOKEN = """'[모의 번역] ' || text || ', "' || seg_id || '"' || chr(10) || 'end,' """


_SPOKEN = """'[모의 번역] ' || text || ', "' || seg_id || '"' || chr(10) || 'end,' """


@query("S15 X5", f"""
WITH {S.SEGMENTS}, e AS (SELECT doc_id, seg_id, CAST(page + 1 AS BIGINT) AS page, text, {_SPOKEN} AS spoken FROM segs WHERE needs)
SELECT kind, doc_id, seg_id AS segment_id, page, text AS source, spoken AS translated FROM e, (VALUES ('csv'), ('json')) AS k(kind)
UNION ALL SELECT 'txt', NULL, NULL, NULL, NULL, unnest(string_split(spoken, chr(10))) FROM e""")
def plain_exports(spark, sf):
    """All mapped segments, with quotes and line breaks, as CSV, JSON lines and text, and what is read back."""
    spoken = F.concat(F.lit(K.MOCK_PREFIX), F.col("text"), F.lit(', "'), F.col("seg_id"), F.lit('"\nend,'))
    pairs = reconcile.export_pairs(doc_segments(spark, sf).withColumn("translated", spoken), "doc_id")
    folder = work_path(spark, "exports")
    for kind in ("csv", "json", "txt"):
        files.write_pairs(pairs, f"{folder}/{kind}", kind, "gzip")
    schema = "doc_id bigint, segment_id string, page bigint, source string, translated string"
    rows = [
        spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(f"{folder}/csv")
        .withColumn("kind", F.lit("csv")),
        spark.read.schema(schema).json(f"{folder}/json").withColumn("kind", F.lit("json")),
        spark.read.text(f"{folder}/txt").select(F.col("value").alias("translated"), F.lit("txt").alias("kind")),
    ]
    out = rows[0].unionByName(rows[1]).unionByName(rows[2], allowMissingColumns=True)
    return out.select("kind", "doc_id", "segment_id", "page", "source", "translated")


# --- memo --------------------------------------------------------------------


def _entries(spark, sf, rule: str, prefix: str, seq: int):
    """Memo rows of a run that worked on the documents that a rule gives it."""
    s = scan(table(spark, sf, "documents").where(rule)).where("needs")
    return memo.entries(
        s.withColumn("translated", F.concat(F.lit(prefix), F.col("text"))), F.lit("English"),
        F.lit("Korean"), F.lit(""), F.lit(seq), F.lit(_FIXED_TIME).cast("timestamp"),
    )


def _key(c):
    return memo_key(c, F.lit("English"), F.lit("Korean"), F.lit(""))


# two runs share a third of the documents, and between them see all
_FIRST, _SECOND = "doc_id % 3 <> 2", "doc_id % 3 <> 0"
# for lookups, a quarter of the documents is new
_DONE_FIRST, _DONE_SECOND = "doc_id % 4 <= 1", "doc_id % 4 IN (1, 2)"


def _upserted(first: str, second: str) -> str:
    return f"""{S.SEGMENTS},
up AS (SELECT text, arg_max(t, seq) AS t FROM (
  SELECT text, 'old ' || text AS t, 0 AS seq FROM segs WHERE needs AND {first}
  UNION ALL SELECT text, 'new ' || text, 1 FROM segs WHERE needs AND {second}) GROUP BY text)"""


_UPSERTED = _upserted(_FIRST, _SECOND)


@query("M1 M2 S8", f"""
WITH {_UPSERTED}
SELECT sha256('v3||' || text || '||English||Korean||') AS cache_key, text AS source_text, t AS translated_text FROM up""")
def memo_upsert(spark, sf):
    merged = memo.upsert(_entries(spark, sf, _FIRST, "old ", 0), _entries(spark, sf, _SECOND, "new ", 1))
    return merged.select("cache_key", "source_text", "translated_text")


@query("S9 S10 S8", f"""
WITH {_UPSERTED}
SELECT 'full' AS state, count(*) AS entries, round(sum(strlen(text) + strlen(t)) / 1048576.0, 2)::DOUBLE AS size_mb FROM up
UNION ALL SELECT 'cleared', 0, 0.0""")
def memo_stats(spark, sf):
    """Statistics of a stored memo before and after truncation."""
    path, into = work_path(spark, "memo"), work_path(spark, "memo-compact")
    memo.create_empty(spark, path)
    memo.append(_entries(spark, sf, _FIRST, "old ", 0), path, 0)
    memo.append(_entries(spark, sf, _SECOND, "new ", 1), path, 1)
    memo.compact(spark, path, into)
    memo.clear(spark, path)
    full = memo.stored_stats(spark, into).withColumn("state", F.lit("full"))
    cleared = memo.stored_stats(spark, path).withColumn("state", F.lit("cleared"))
    return full.unionByName(cleared)


_ASKED = f"""{_upserted(_DONE_FIRST, _DONE_SECOND)},
asked AS (SELECT text AS k, CASE WHEN pos % 2 = 1 THEN text || '  ' ELSE text END AS src,
  doc_id * 100000 + pos AS ord FROM segs WHERE needs)"""


def _asked(spark, sf):
    s = doc_segments(spark, sf).where("needs")
    padded = F.when(F.col("pos") % 2 == 1, F.concat("text", F.lit("  "))).otherwise(F.col("text"))
    return s.select(
        _key(padded).alias("cache_key"), padded.alias("text"),
        (F.col("doc_id") * 100_000 + F.col("pos")).alias("ord"),
    )


def _stored(spark, sf):
    return memo.upsert(
        _entries(spark, sf, _DONE_FIRST, "old ", 0), _entries(spark, sf, _DONE_SECOND, "new ", 1))


@query("J2 J2a", f"""
WITH {_ASKED}
SELECT src AS text, t AS translated FROM (SELECT k, arg_max(src, ord) AS src FROM asked GROUP BY k) a
JOIN up ON up.text = a.k""")
def memo_hits(spark, sf):
    return memo.hits(_asked(spark, sf), _stored(spark, sf))


@query("J2", f"WITH {_ASKED} SELECT src AS text, ord FROM asked WHERE k NOT IN (SELECT text FROM up)")
def memo_misses(spark, sf):
    return memo.misses(_asked(spark, sf), _stored(spark, sf)).select("text", "ord")


@query("J9 S16", """
SELECT d.doc_id, coalesce('tm ' || m.text, '') AS translated FROM documents d
LEFT JOIN (SELECT DISTINCT lang, text FROM documents WHERE doc_id % 4 <> 3) m ON m.text = d.text AND m.lang = d.lang""")
def memory_lookup(spark, sf):
    """A translation memory that lacks a quarter of the documents, saved, loaded and looked up exactly."""
    from folioflow.operators.skew import heavy_keys, join_unique

    d = table(spark, sf, "documents")
    keyed = d.withColumn("key", F.sha2(memory_key(F.col("text"), F.col("lang"), F.lit("ko")), 256))
    path = work_path(spark, "memory")
    keyed.where("doc_id % 4 <> 3").groupBy("key").agg(
        F.concat(F.lit("tm "), F.any_value("text")).alias("translated")
    ).write.parquet(path)
    counts = keyed.groupBy("key").agg(F.count("*").alias("n"))
    found = join_unique(
        keyed.select("doc_id", "key"), spark.read.parquet(path), "key",
        heavy_keys(counts, "key"), ["doc_id"],
    )
    return found.select("doc_id", F.coalesce("translated", F.lit("")).alias("translated"))


@query("M4", f"""
SELECT event_id FROM events WHERE CASE event_id % 3 WHEN 0 THEN true
  WHEN 1 THEN epoch_us(TIMESTAMP '{_FIXED_TIME}') - epoch_us(ts) <= 864000000000
  ELSE epoch_us(TIMESTAMP '{_FIXED_TIME}') - epoch_us(ts) <= 3600000000 END""")
def unexpired_entries(spark, sf):
    n = F.col("event_id") % 3
    ttl = F.when(n == 1, 864_000).when(n == 2, 3_600)
    e = table(spark, sf, "events").withColumn("created_at", F.col("ts").cast("timestamp"))
    return memo.unexpired(e, F.lit(_FIXED_TIME).cast("timestamp"), ttl).select("event_id")


@query("O9", """
SELECT 'k' || event_id AS cache_key FROM (SELECT event_id, row_number() OVER (ORDER BY ts, 'k' || event_id) AS r,
  count(*) OVER () AS n FROM events) WHERE n <= 500 OR r > n // 2""")
def evicted_cache(spark, sf):
    e = table(spark, sf, "events").select(
        F.concat(F.lit("k"), "event_id").alias("cache_key"), F.col("ts").cast("timestamp").alias("last_access")
    )
    return memo.evict_oldest_half(e).select("cache_key")


# --- histories, sessions, queues ---------------------------------------------


@query("S17 O5", """
SELECT event_id AS id, event_type AS action, props AS details FROM events WHERE event_type <> 'view'
ORDER BY ts DESC, event_id LIMIT 100""")
def history(spark, sf):
    """The newest records of a history, after removing the views by id."""
    every = table(spark, sf, "events")
    removed = every.where(F.col("event_type") == "view").select("event_id")
    e = every.join(removed, "event_id", "left_anti")
    top = memo.newest(e, K.HISTORY_LIMIT, F.desc("ts"), F.asc("event_id"))
    return top.select(F.col("event_id").alias("id"), F.col("event_type").alias("action"), F.col("props").alias("details"))


@query("S18", f"""
WITH {STATUS_SQL}
SELECT user_id, page % 20 AS chunk_id, CASE WHEN bool_or(event_type <> 'error') THEN 'completed' ELSE 'failed' END AS state
FROM status GROUP BY user_id, page % 20""")
def session_status(spark, sf):
    mark = F.when(F.col("event_type") == "error", "failed").otherwise("completed")
    s = page_status(spark, sf).select("user_id", (F.col("page") % 20).alias("chunk_id"), mark.alias("mark"))
    return tasks.session_status(s, ["user_id"])


@query("O4", """
SELECT 'f' || user_id AS file, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS at FROM events GROUP BY user_id
ORDER BY 2 DESC, 1 LIMIT 10""")
def recent_files(spark, sf):
    opened = table(spark, sf, "events").select(
        F.concat(F.lit("f"), "user_id").alias("file"), F.date_format("ts", _MICROS).alias("at")
    )
    return memo.recent_files(opened)


@query("O6", """
SELECT event_id, event_id % 11 AS priority FROM events WHERE event_type = 'click'
ORDER BY event_id % 11, event_id LIMIT 50""")
def queue_head(spark, sf):
    """The next chunks of a priority queue; equal priorities in order of arrival."""
    waiting = table(spark, sf, "events").where(F.col("event_type") == "click")
    queued = waiting.select("event_id", (F.col("event_id") % 11).alias("priority"))
    return memo.newest(queued, 50, F.asc("priority"), F.asc("event_id"))


@query("O7", "SELECT user_id, min(event_id) AS job_id FROM events WHERE event_type = 'view' GROUP BY user_id")
def next_jobs(spark, sf):
    """The oldest waiting job of every first-in-first-out queue."""
    waiting = table(spark, sf, "events").where(F.col("event_type") == "view")
    return waiting.groupBy("user_id").agg(F.min("event_id").alias("job_id"))


@query("O8", f"""
WITH {STATUS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY page DESC) AS n FROM status)
SELECT user_id, page AS line_no, props AS line FROM r WHERE n <= 25""")
def log_tails(spark, sf):
    lines = page_status(spark, sf).select("user_id", F.col("page").alias("line_no"), F.col("props").alias("line"))
    return memo.log_tail(lines, "user_id")


@query("A15", """
SELECT user_id, CAST(sum(length(props) // 4 + event_id % 50) AS BIGINT) AS total_tokens, round(sum(value), 4) AS estimated_cost,
  count(*) FILTER (event_type <> 'error') AS successful_chunks, count(*) FILTER (event_type = 'error') AS failed_chunks,
  CAST(sum(event_id % 3) AS BIGINT) AS retries FROM events GROUP BY user_id""")
def usage_totals(spark, sf):
    log = table(spark, sf, "events").select(
        "user_id", F.floor(F.length("props") / 4).alias("input_tokens"),
        (F.col("event_id") % 50).alias("output_tokens"), F.col("value").alias("cost"),
        (F.col("event_type") != "error").alias("ok"), (F.col("event_id") % 3).alias("retries"),
    )
    return tasks.usage(log, ["user_id"]).withColumn("estimated_cost", F.round("estimated_cost", 4))


def _tasks(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn")
    ids = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("task_id"), "turn")
    before = F.filter(
        F.array(F.col("task_id") - 1, F.when(F.col("turn") > 1, F.col("task_id") - 2)), lambda t: t.isNotNull()
    )
    needs = ids.where(F.col("turn") > 0).select("task_id", F.explode(before).alias("needed_id"))
    return ids, needs


@query("R9", """
SELECT conv_id * 1000 + turn AS task_id, CASE WHEN turn <= 2 THEN 'PENDING' ELSE 'QUEUED' END AS state,
  CASE WHEN turn <= 2 THEN 0 WHEN turn = 3 THEN 1 ELSE 2 END::BIGINT AS open_needs FROM conversations""")
def released_tasks(spark, sf):
    ids, needs = _tasks(spark, sf)
    queued = ids.select("task_id", F.lit("QUEUED").alias("state"))
    return tasks.release_ready(queued, needs, ids.where(F.col("turn") < 2).select("task_id"))


@query("R9", "SELECT conv_id * 1000 + turn AS task_id, CAST(turn AS INTEGER) AS level FROM conversations")
def task_levels(spark, sf):
    ids, needs = _tasks(spark, sf)
    return tasks.levels(needs, ids)


@query("R9", """
SELECT event_id AS task_id, CASE WHEN event_type <> 'error' THEN 'RUNNING' WHEN event_id % 5 < 3 THEN 'RETRYING' ELSE 'FAILED' END AS state,
  CASE WHEN event_type = 'error' AND event_id % 5 < 3 THEN event_id % 5 + 1 ELSE event_id % 5 END AS retries FROM events""")
def failed_tasks(spark, sf):
    t = table(spark, sf, "events").select(
        F.col("event_id").alias("task_id"), F.lit("RUNNING").alias("state"),
        (F.col("event_id") % 5).alias("retries"), (F.col("event_type") == "error").alias("_f"),
    )
    return tasks.after_failure(t, F.col("_f")).drop("_f")


@query("R5", f"""
WITH f AS (SELECT user_id AS key, ts AS tm, event_id % 50 AS n, event_id FROM events WHERE event_type = 'error'),
m AS (SELECT key, tm, n, CASE WHEN n = 0 THEN 'unauthorized' WHEN n < 25 THEN 'quota exceeded, retry in ' || n || '0s'
    WHEN n < 40 THEN 'insufficient_quota' ELSE 'timeout' END AS message FROM f),
l AS (SELECT key, max(tm) AS tm, arg_max(n, tm) AS n, bool_or(n = 0) AS refused FROM m WHERE n < 40 GROUP BY key),
r AS (SELECT key, refused, CASE WHEN NOT refused THEN epoch_us(tm) + CASE WHEN n < 25 THEN n * 10 + 2 ELSE 1800 END * 1000000 END AS revive_at FROM l)
SELECT key, refused, strftime(make_timestamp(revive_at::BIGINT), '%Y-%m-%d %H:%M:%S.%f') AS revive_at,
  coalesce(revive_at <= epoch_us(TIMESTAMP '{_FIXED_TIME}'), false) AS alive,
  coalesce(revive_at - epoch_us(TIMESTAMP '{_FIXED_TIME}') <= 600000000, false) AS worth_waiting FROM r""")
def key_revival(spark, sf):
    n = F.col("event_id") % 50
    message = (
        F.when(n == 0, "unauthorized")
        .when(n < 25, F.concat(F.lit("quota exceeded, retry in "), n, F.lit("0s")))
        .when(n < 40, "insufficient_quota").otherwise("timeout")
    )
    failures = table(spark, sf, "events").where(F.col("event_type") == "error").select(
        F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at"),
        F.lit(None).cast("int").alias("code"), message.alias("message"),
    )
    states = tasks.key_states(failures, F.lit(_FIXED_TIME).cast("timestamp"))
    return states.withColumn("revive_at", F.date_format(F.timestamp_micros("revive_at"), _MICROS))


@query("S14 S19", "SELECT doc_id, text FROM documents")
def snapshots(spark, sf):
    """Two labelled, compressed copies of the documents; the newest is read."""
    path = work_path(spark, "snapshots")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    files.write_snapshot(docs.withColumn("text", F.lit("old")), path, "20240101_000000")
    files.write_snapshot(docs, path, "20240102_000000")
    return files.read_snapshot(spark, path)
