"""Match a mapper's answers with the segments that were sent."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow import constants as K
from folioflow.functions.arrow import arrow_batched
from folioflow.functions.binding import let
from folioflow.functions.prompts import mock_mapping
from folioflow.functions.scripts import is_echo, is_plausible_pair
from folioflow.functions.text import strip

PAIRS = "array<struct<segment_id:string,translated_text:string>>"
PARSED_TYPE = f"struct<pairs:{PAIRS},error:string>"
_COMPLETE_PAIR = re.compile(K.ANSWER_PAIR, re.DOTALL)
_OPENING = re.compile(K.ANSWER_OPENING)
_CLOSING = re.compile(K.ANSWER_CLOSING)
_THINKING = re.compile(K.ANSWER_THINKING, re.DOTALL)


def _object_text(raw: str) -> str:
    bare = _CLOSING.sub("", _OPENING.sub("", raw.strip()))
    bare = _THINKING.sub("", bare)
    first, last = bare.find("{"), bare.rfind("}")
    return bare[first:last + 1] if 0 <= first < last else ""


def _recovered(payload: str) -> list[dict]:
    found = []
    for sid, text in _COMPLETE_PAIR.findall(payload):
        try:
            found.append({
                "segment_id": json.loads(sid), "translated_text": json.loads(text, strict=False),
            })
        except json.JSONDecodeError:
            pass
    return found


def parse_answer_one(raw: str | None) -> dict:
    """Pairs of a model answer in answer order; broken JSON gives its complete pairs."""
    payload = _object_text(raw or "")
    if not payload:
        return {"pairs": None, "error": "no json object"}
    try:
        items = json.loads(payload).get("translations", [])
    except (json.JSONDecodeError, RecursionError):
        items = _recovered(payload)
        if not items:
            try:
                items = json.loads(payload, strict=False).get("translations", [])
            except (json.JSONDecodeError, RecursionError):
                return {"pairs": None, "error": "invalid json"}
    if not isinstance(items, list):
        return {"pairs": None, "error": "translations is no list"}
    pairs = [(i.get("segment_id"), i.get("translated_text")) for i in items if isinstance(i, dict)]
    return {
        "pairs": [
            {"segment_id": s, "translated_text": t}
            for s, t in pairs
            if isinstance(s, str) and isinstance(t, str) and t.strip()
        ],
        "error": None,
    }


@arrow_batched(PARSED_TYPE)
def parse_answer(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_answer_one(r) for r in raw], columns=["pairs", "error"])


def parse_strict(raw: Column) -> Column:
    """Native parser for answers that are one well-formed object, fenced or not."""
    bare = F.regexp_replace(strip(raw), r"\A```[a-zA-Z]*\s*|\s*```\z", "")
    bare = F.regexp_replace(bare, r"(?s)<think>.*?</think>", "")
    body = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    pairs = F.from_json(body, f"struct<translations:{PAIRS}>")["translations"]
    return F.filter(
        pairs, lambda p: p["segment_id"].isNotNull() & (strip(p["translated_text"]) != "")
    )


def reconcile(todo: Column, pairs: Column, target_lang: Column) -> Column:
    """ARRAY<STRUCT<seg_id, text, translated>> in sent order; NULL where nothing fits.

    As many answers as segments: matched by position, whatever their ids say.
    Otherwise by id, the last answer of an id winning and unknown ids dropped.
    Pairs that look mismatched or untranslated are rejected. Batches are small
    by construction, so this stays inside the row.
    """
    positional = F.size(pairs) == F.size(todo)

    def answer(segment: Column, i: Column) -> Column:
        by_id = F.filter(pairs, lambda p: p["segment_id"] == segment["seg_id"])
        return F.when(positional, F.try_element_at(pairs, i + 1)).otherwise(
            F.try_element_at(by_id, F.lit(-1))
        )["translated_text"]

    def accepted(segment: Column, out: Column) -> Column:
        fits = is_plausible_pair(segment["text"], out) & ~is_echo(segment["text"], out, target_lang)
        return F.struct(
            segment["seg_id"].alias("seg_id"), segment["text"].alias("text"),
            F.when(fits, out).alias("translated"),
        )

    return F.transform(
        todo, lambda s, i: let(answer(s, i), lambda out: accepted(s, out))
    )


def mock_answer(segments: Column) -> Column:
    """The default mapper: a well-formed answer with a prefix before every text."""
    return F.to_json(F.struct(
        F.transform(
            segments,
            lambda s: F.struct(
                s["seg_id"].alias("segment_id"), mock_mapping(s["text"]).alias("translated_text")
            ),
        ).alias("translations")
    ))


class OversizeError(Exception):
    """Raised by a mapper whose request was too large; the batch is halved."""


Mapper = Callable[[Sequence[dict]], str]


def _answer_pairs(mapper: Mapper, segments: list[dict]) -> tuple[list[dict], list[str]]:
    """Pairs and errors of a batch. A batch that is too large is halved until it fits.

    What one half has answered stays, whatever becomes of the other.
    """
    try:
        answer = parse_answer_one(mapper(segments))
        return answer["pairs"] or [], [answer["error"]] if answer["error"] else []
    except OversizeError as failure:
        if len(segments) == 1:
            return [], [str(failure) or "segment too large"]
        half = len(segments) // 2
        left, right = _answer_pairs(mapper, segments[:half]), _answer_pairs(mapper, segments[half:])
        return left[0] + right[0], left[1] + right[1]
    except Exception as failure:  # one bad batch must not end the job
        return [], [str(failure) or type(failure).__name__]


def map_batches(batches: DataFrame, make_mapper: Callable[[], Mapper], keys: Sequence[str]) -> DataFrame:
    """Run a Python mapper over batch rows: keys, segments -> keys, segments, pairs, error.

    ``make_mapper`` runs once per task, so a client or model is opened once.
    A retried task repeats its calls; keep mappers idempotent.
    """
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    source = batches.select(*keys, "segments")
    element = T.StructType.fromDDL(f"p {PAIRS}")["p"].dataType
    schema = T.StructType([*source.schema.fields, T.StructField("pairs", element),
                           T.StructField("error", T.StringType())])

    answered = to_arrow_type(element)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapper = make_mapper()
        for part in parts:
            pairs, errors = [], []
            for segments in part.column("segments"):  # one batch of segments as objects at a time
                found, failures = _answer_pairs(mapper, segments.as_py())
                pairs.append(found)
                errors.append("; ".join(failures) or None)
            # what was sent goes back as it came
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(pairs, answered), pa.array(errors, pa.string())], schema.names)

    return source.mapInArrow(run, schema)


def with_fallback(rows: DataFrame, source: str = "text", mapped: str = "translated") -> DataFrame:
    """Keep the source where nothing was mapped and flag the row as failed."""
    return rows.withColumn("failed", F.col(mapped).isNull()).withColumn(
        mapped, F.coalesce(F.col(mapped), F.col(source))
    )


def import_pairs(segments: DataFrame, pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fill ``translated`` of target segments from imported pairs; the last pair of a key wins."""
    latest = pairs.groupBy(*keys).agg(F.max_by("translated", "pos").alias("_imported"))
    usable = F.col("needs") & (F.col("_imported") != "")
    return (
        segments.join(latest, list(keys), "left")
        .withColumn("translated", F.coalesce(F.when(usable, F.col("_imported")), "translated"))
        .drop("_imported")
    )


def export_pairs(segments: DataFrame, key: str) -> DataFrame:
    """Target segments as interchange rows: 1-based page, source, translation."""
    return segments.where("needs").select(
        key, F.col("seg_id").alias("segment_id"), (F.col("page") + 1).alias("page"),
        F.col("text").alias("source"), "translated",
    )
