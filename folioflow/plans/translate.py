"""The document plan: scan, protect, batch, map, reconcile, check, restore.

``translate`` keeps each document in its row from the scan to the mapped
batches, so the whole plan runs without a shuffle. ``pending`` and ``finish``
add the memo: equal texts are mapped once in the corpus and never again.
``translate_through_memo`` composes both around a mapper of your own.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow import constants as K
from folioflow.functions import tokens
from folioflow.functions.arrow import arrow_batched
from folioflow.functions.keys import memo_key
from folioflow.functions.markup import fence_fault_one, markup_fault
from folioflow.functions.prompts import mock_mapping
from folioflow.functions.text import has_letter, is_label, normalize_one, segment_lines
from folioflow.operators import batching, blocked, memo
from folioflow.operators.context import context_reply, sample
from folioflow.operators.reconcile import map_batches, mock_answer, parse_strict, reconcile
from folioflow.operators.segments import scan, segment_id
from folioflow.session import discard, lean_copy, materialize


@dataclass(frozen=True)
class Options:
    """Which steps of the plan run."""

    glossary: bool = True
    placeholders: bool = True
    validation: bool = True
    style: bool = True


def protected_documents(documents: DataFrame, terms: dict[str, str] | None = None,
                        key: str = "doc_id", text: str = "text", placeholders: bool = True) -> DataFrame:
    """key, lines (their number), targets: ARRAY<STRUCT<pos, page, seg_id, source, text, held, terms>>.

    ``text`` is the protected text, ``source`` the original one.
    """
    lines = documents.select(key, segment_lines(F.coalesce(F.col(text), F.lit(""))).alias("_lines"))
    none = F.array().cast("array<string>")
    if placeholders:
        protected = tokens.line_protector(terms)("_lines")
    else:
        protected = F.transform(
            "_lines", lambda t: F.struct(t.alias("text"), none.alias("held"), none.alias("terms"))
        )

    def segment(line: Column, pos: Column) -> Column:
        page = F.floor(pos / K.LINES_PER_PAGE).cast("int")
        kept = F.col("_protected")[pos]
        return F.struct(
            pos.alias("pos"), page.alias("page"),
            segment_id(page, pos % K.LINES_PER_PAGE).alias("seg_id"), line.alias("source"),
            kept["text"].alias("text"), kept["held"].alias("held"), kept["terms"].alias("terms"),
        )

    return lines.withColumn("_protected", protected).select(
        key, F.size("_lines").alias("lines"),
        F.filter(F.transform("_lines", segment), lambda s: has_letter(s["source"])).alias("targets"),
    )


def document_batches(targets: DataFrame, key: str = "doc_id", max_chars: int = K.BATCH_CHARS,
                     max_segments: int = K.BATCH_SEGMENTS) -> DataFrame:
    """One row per batch: key, batch_id, start, segments. No shuffle."""
    starts = batching.starts_in_row(max_chars, max_segments)(
        F.transform("targets", lambda s: F.length(s["text"])),
        F.transform("targets", lambda s: is_label(s["text"])),
    )
    cut = targets.withColumn("_starts", starts).withColumn(
        "_batches", batching.slices(F.col("targets"), F.col("_starts"))
    )
    return cut.select(key, F.posexplode(F.arrays_zip("_starts", "_batches")).alias("batch_id", "_b")).select(
        key, "batch_id", F.col("_b._starts").alias("start"), F.col("_b._batches").alias("segments")
    )


def _finisher(normalise: bool, check_fences: bool):
    @arrow_batched("struct<text:string, error:string, fence:string>")
    def finish_text(texts: pd.Series, held: pd.Series, terms: pd.Series) -> pd.DataFrame:
        """Normalise, restore and check fenced blocks in one trip to Python."""
        rows = [
            tokens.restore_one(normalize_one(t) if normalise else t, h, g)
            for t, h, g in zip(texts, held, terms)
        ]
        return pd.DataFrame(
            [(r["text"], r["error"], fence_fault_one(r["text"]) if check_fences else None) for r in rows],
            columns=["text", "error", "fence"],
        )

    return finish_text


def finish_segments(mapped: DataFrame, options: Options = Options()) -> DataFrame:
    """Check, normalise and restore mapped segments; faults become a column, not a failure.

    ``mapped`` has source, text (protected), held, terms and translated. A
    segment without a sound result keeps its source and is flagged. Without
    placeholders nothing is normalised or restored.
    """
    finish = _finisher(options.placeholders and options.style, options.validation)
    finished = mapped.withColumn("_restored", finish("translated", "held", "terms"))
    # what the mapper said, where it said something
    unmapped = F.coalesce(F.col("error"), F.lit("not mapped")) if "error" in mapped.columns else F.lit("not mapped")
    faults = [F.when(F.col("translated").isNull(), unmapped)]
    if options.validation and options.placeholders:
        faults.append(tokens.token_error(F.col("text"), F.col("translated")))
    if options.placeholders:
        faults.append(F.col("_restored.error"))
    if options.validation:
        faults.append(markup_fault(F.col("_restored.text"), F.col("_restored.fence")))
    return (
        finished.withColumn("error", F.coalesce(*faults) if len(faults) > 1 else faults[0])
        .withColumn("failed", F.col("error").isNotNull())
        .withColumn("translated", F.when(F.col("failed"), F.col("source"))
                    .otherwise(F.col("_restored.text")))
        .drop("_restored", "text", "held", "terms")
    )


class RunMetrics:
    """What a run did, counted by Spark while it ran: no second scan.

    Give one to ``translate``; its numbers are there once the result was written or
    collected, and describe that one action. They come from finished tasks; a task that is run again for
    a lost executor may count twice, so exact totals of such a run need ``run_summary``.
    """

    def __init__(self):
        self.scan, self.finish = Observation(), Observation()

    def summary(self) -> dict[str, int]:
        """segments, targets, skipped, target_chars, translated, failed."""
        got = {**self.scan.get, **self.finish.get}
        got = {k: v or 0 for k, v in got.items()}
        return {**got, "skipped": got["segments"] - got["targets"]}

    def percent(self) -> float:
        got = self.summary()
        return 100.0 * got["translated"] / max(1, got["targets"])

    def frame(self, spark) -> DataFrame:
        names = ["segments", "targets", "skipped", "target_chars", "translated", "failed"]
        got = self.summary()
        return spark.createDataFrame([tuple(int(got[n]) for n in names)], ", ".join(f"{n} long" for n in names))


def finished(answered: DataFrame, key: str, target_lang: str, options: Options) -> DataFrame:
    """Answered batches (segments, pairs, error) -> one checked row per segment."""
    matched = answered.withColumn(
        "_matched", reconcile(F.col("segments"), F.col("pairs"), F.lit(target_lang))
    )
    rows = matched.select(
        key, "batch_id", "error", F.explode(F.arrays_zip("segments", "_matched")).alias("_z")
    ).select(key, "batch_id", "error", *[F.col(f"_z.segments.{f}").alias(f) for f in (
        "pos", "page", "seg_id", "source", "text", "held", "terms")], F.col("_z._matched.translated").alias("translated"))
    return finish_segments(rows, options)


def translate(documents: DataFrame, target_lang: str = "Korean", terms: dict[str, str] | None = None,
              make_mapper=None, key: str = "doc_id", options: Options = Options(), metrics: RunMetrics | None = None,
              keep: Sequence[str] = ()) -> DataFrame:
    """key, batch_id, pos, page, seg_id, source, translated, error, failed for all targets.

    ``metrics`` counts segments, targets and results on the way. The mapper's segments
    also carry the columns in ``keep``, which may name the key.
    """
    used = terms if options.glossary else None
    targets = protected_documents(documents, used, key, placeholders=options.placeholders)
    if metrics is not None:
        length = F.aggregate("targets", F.lit(0).cast("bigint"), lambda a, s: a + F.length(s["source"]))
        targets = targets.observe(metrics.scan, F.sum("lines").alias("segments"), F.sum(F.size("targets")).alias("targets"),
                                  F.sum(length).alias("target_chars"))
    batches = document_batches(targets, key)
    if keep:
        batches = batches.withColumn("segments", F.transform("segments", lambda s: F.struct(
            *[s[f].alias(f) for f in ("pos", "page", "seg_id", "source", "text", "held", "terms")],
            *[F.col(c).alias(c) for c in keep])))
    if make_mapper is None:
        answered = batches.withColumn("pairs", parse_strict(mock_answer(F.col("segments")))).withColumn(
            "error", F.lit(None).cast("string"))
    else:
        answered = map_batches(batches, make_mapper, [key, "batch_id"])
    done = finished(answered, key, target_lang, options)
    if metrics is None:
        return done
    return done.observe(metrics.finish, F.count_if(~F.col("failed")).alias("translated"), F.count_if("failed").alias("failed"))


def document_contexts(documents: DataFrame, make_classifier, key: str = "doc_id") -> DataFrame:
    """Category of every document, from a classifier that sees a sample of its targets.

    ``make_classifier`` runs once per task and returns a function from sample
    to JSON reply. Documents without targets and odd replies are ``default``.
    """
    lines = F.filter(segment_lines(F.col("text")), has_letter)
    samples = documents.select(key, sample(lines).alias("sample"))
    schema = T.StructType([samples.schema[key], T.StructField("reply", T.StringType())])

    def classify(parts):
        ask = make_classifier()
        for part in parts:
            replies = [ask(text) if text else None for text in part["sample"]]
            yield part[[key]].assign(reply=replies)

    return samples.mapInPandas(classify, schema).select(
        key, context_reply(F.col("reply")).alias("context")
    )


def keyed_segments(documents: DataFrame, source_lang: str, target_lang: str, glossary: str = "",
                   key: str = "doc_id") -> DataFrame:
    """Target segments with their memo key."""
    targets = scan(documents, key).where("needs")
    return targets.withColumn(
        "cache_key",
        memo_key(F.col("text"), F.lit(source_lang), F.lit(target_lang), F.lit(glossary)),
    )


def distinct_segments(documents: DataFrame, source_lang: str, target_lang: str, key: str = "doc_id") -> DataFrame:
    """One owner segment per memo key."""
    return memo.distinct_work(keyed_segments(documents, source_lang, target_lang, key=key), [key, "pos"])


def pending(documents: DataFrame, stored: DataFrame, source_lang: str, target_lang: str,
            key: str = "doc_id") -> DataFrame:
    """Distinct unfinished work: one owner segment per key the memo does not hold.

    ``stored`` may hold several rows per key; an anti-join does not mind.
    """
    return pending_segments(keyed_segments(documents, source_lang, target_lang, key=key), stored, key)


def pending_segments(segments: DataFrame, stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """The same of keyed segments, which a run writes out once for this and ``finish_segments_from``."""
    return memo.misses(memo.distinct_work(segments, [key, "pos"]), stored)


def batched_work(work: DataFrame, key: str = "doc_id") -> DataFrame:
    """Batch numbers for segment rows of groups of any size: key, pos, idx, batch_id."""
    return batching.assign_batches(
        blocked.with_block(work, F.col("pos")), [key], ["pos"], F.length("text"),
        is_label(F.col("text")),
    )


def mock_results(work: DataFrame, source_lang: str, target_lang: str, seq: int = 0) -> DataFrame:
    """Memo rows of the default mapper for pending work, as run number ``seq``."""
    return memo.entries(
        work.withColumn("translated", mock_mapping(F.col("text"))), F.lit(source_lang),
        F.lit(target_lang), F.lit(""), F.lit(seq),
    )


def finish(documents: DataFrame, stored: DataFrame, source_lang: str, target_lang: str,
           key: str = "doc_id") -> DataFrame:
    """All target segments with their finished text from the memo."""
    segments = keyed_segments(documents, source_lang, target_lang, key=key)
    return finish_segments_from(materialize(segments, "segments"), stored, key)


def finish_segments_from(segments: DataFrame, stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """The same of keyed segments, a table."""
    results = stored.select("cache_key", F.col("translated_text").alias("translated"))
    return memo.spread_results(segments, results, [key, "pos"])


def _asked_batches(work: DataFrame, key: str, terms: dict[str, str] | None, options: Options, attempt: int) -> DataFrame:
    """Open work in batches: key, batch_id, segments. A batch holds at most BATCH_SEGMENTS rows.

    Open segments of a document are a part of its row, so they meet in one row and are cut there.
    """
    none = F.array().cast("array<string>")
    if options.placeholders:
        protected = tokens.protector(terms if options.glossary else None)("text")
    else:
        protected = F.struct(F.col("text"), none.alias("held"), none.alias("terms"))
    segment = F.struct(
        "pos", "page", "seg_id", "cache_key", F.col("text").alias("source"), F.col("_p.text").alias("text"),
        F.col("_p.held").alias("held"), F.col("_p.terms").alias("terms"), F.lit(attempt).alias("attempt"))
    rows = work.withColumn("_p", protected).groupBy(key).agg(F.array_sort(F.collect_list(segment)).alias("_open"))
    starts = batching.starts_in_row()(
        F.transform("_open", lambda s: F.length(s["source"])), F.transform("_open", lambda s: is_label(s["source"])))
    cut = rows.withColumn("_starts", starts)
    return cut.select(key, F.posexplode(batching.slices(F.col("_open"), F.col("_starts"))).alias("batch_id", "segments"))


def _with_texts(work: DataFrame, texts: DataFrame, key: str, cache_key: Column) -> DataFrame:
    """Open work with its texts: key, pos, cache_key, text; ``cache_key`` tells the key of a text.

    Both meet by document, as the work is cut into batches by document next: texts are shuffled once for both.
    """
    none = F.lit(None).cast("string")
    told = texts.select(key, "pos", "text", none.alias("cache_key"))
    met = told.unionByName(work.select(key, "pos", none.alias("text"), "cache_key")).repartition(key)
    named = met.withColumn("_open", F.col("text").isNull()).withColumn("cache_key", F.coalesce("cache_key", cache_key))
    return named.groupBy(key, "pos", "cache_key").agg(
        F.max("_open").alias("_open"), F.first("text", ignorenulls=True).alias("text")).where("_open").drop("_open")


def _named(work: DataFrame) -> DataFrame:
    """Work with the page and the segment id of its position."""
    page = F.floor(F.col("pos") / K.LINES_PER_PAGE).cast("int")
    return work.withColumn("page", page).withColumn("seg_id", segment_id(page, F.col("pos") % K.LINES_PER_PAGE))


def translate_through_memo(documents: DataFrame, memo_path: str, make_mapper, source_lang: str, target_lang: str,
                           terms: dict[str, str] | None = None, key: str = "doc_id", glossary: str = "",
                           options: Options = Options(), attempts: int = 3, with_text: bool = True) -> DataFrame:
    """key, pos, text, translated, error, failed for all targets; every distinct text is mapped once.

    Work that the memo lacks is batched, mapped, reconciled, checked and restored;
    sound results are appended to the memo after each attempt, and what is still
    open is asked again, up to ``attempts`` times. The segments a mapper gets
    carry the number of the attempt. A text without a sound result keeps its
    source and says why. The memo has to exist (``memo.create_empty``).
    Copies are packed, and deleted once the next step is written; the result is joined by key,
    so that texts are not shuffled again for those who need no ``text`` beside their results.
    """
    spark = documents.sparkSession
    languages = [F.lit(source_lang), F.lit(target_lang), F.lit(glossary)]
    hashed = memo_key(F.col("text"), *languages).alias("cache_key")
    texts, texts_path = lean_copy(scan(documents, key).where("needs").select(key, "pos", "text"), "texts")
    digest = F.unhex("cache_key").alias("cache_key")  # half as long in a shuffle
    places, _ = lean_copy(texts.select(key, "pos", hashed).select(key, "pos", digest), "places")
    asked, asked_path = lean_copy(memo.distinct_work(places, [key, "pos"]).select(
        key, "pos", F.lower(F.hex("cache_key")).alias("cache_key")), "asked")
    pending, pending_path = asked, None
    if memo.runs(spark, memo_path):
        pending, pending_path = lean_copy(memo.misses(asked, memo.rows_for(asked, memo_path)), "pending")
    none = F.lit(None).cast("string")
    run, work, left, left_path = uuid.uuid4().hex, pending, None, None
    for attempt in range(attempts):
        if work.isEmpty():
            break
        if left is None:
            work = _with_texts(pending, texts, key, hashed)
        answered = map_batches(_asked_batches(_named(work), key, terms, options, attempt), make_mapper, [key, "batch_id"])
        matched = answered.withColumn(
            "_matched", reconcile(F.col("segments"), F.col("pairs"), F.lit(target_lang)))
        rows = matched.select(key, "error", F.explode(F.arrays_zip("segments", "_matched")).alias("_z")).select(
            key, "error", "_z.segments.*", F.col("_z._matched.translated").alias("translated"))
        finished, finished_path = lean_copy(finish_segments(rows, options).select(
            key, "pos", "cache_key", F.col("source").alias("text"), "translated", "error", "failed"), "answers")
        if left is None and not with_text:
            discard(spark, texts_path)
        memo.append(memo.entries(finished.where(~F.col("failed")), *languages, F.lit(attempt)), memo_path, f"{run}-{attempt}")
        # a memo holds no empty texts; they are not asked again
        rest = finished.where(F.col("failed") | (F.col("text") == "") | (F.col("translated") == "")).drop("translated")
        rest = rest if left is None else rest.unionByName(left.where(~F.col("failed")))
        done = [finished_path] if left is None else [finished_path, left_path]
        left, left_path = lean_copy(rest, "faults")
        for path in done:
            discard(spark, path)
        work = left.where("failed")
    if left is None and not work.isEmpty():  # never asked
        left = _with_texts(pending, texts, key, hashed).withColumn("error", none)
    memo.compact_runs(spark, memo_path)
    held = memo.rows_for(asked, memo_path).select("cache_key", "translated_text", "seq").join(asked.select("cache_key"), "cache_key", "left_semi")
    results = memo.latest(held).select(
        "cache_key", F.col("translated_text").alias("translated"), none.alias("error"), none.alias("source"))
    if left is not None:
        results = results.unionByName(left.select("cache_key", none.alias("translated"), "error", F.col("text").alias("source")))
    results, _ = lean_copy(results.withColumn("cache_key", digest), "results")
    for path in (asked_path, pending_path, left_path):
        if path:
            discard(spark, path)
    targets = texts.withColumn("cache_key", hashed).withColumn("cache_key", digest) if with_text else places
    spread = memo.spread_results(targets, results, [key, "pos"])
    return spread.select(
        key, "pos", *(["text"] if with_text else []), F.coalesce("translated", "source").alias("translated"),
        F.when(F.col("translated").isNull(), F.coalesce("error", F.lit("not mapped"))).alias("error"),
        F.col("translated").isNull().alias("failed"))
