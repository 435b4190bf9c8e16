"""The document plan with a mapper that sees context, glossary and prompt of its batch.

A document stays one row up to its batches, which leave the row in order and in one
task. So the pairs that were just answered are at hand for the next batch of the same
document, as in a run that goes through it batch by batch; documents stay parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from folioflow import constants as K
from folioflow.functions.tokens import TermFinder
from folioflow.operators.reconcile import PAIRS, _answer_pairs
from folioflow.plans import translate as plan

#: request (segments, context, glossary, prompt) -> answer text
PromptedMapper = Callable[[dict], str]


@dataclass(frozen=True)
class Prompting:
    """What a prompt is filled with besides the batch; ``template`` holds ``{{marker}}`` texts."""

    template: str
    source_language: str = "auto"
    target_language: str = "Korean"
    document_type: str = ""
    translation_style: str = ""
    terminology_policy: str = ""
    document_title: str = ""
    document_domain: str = ""
    document_instructions: str = ""


def context_text(pairs: Sequence[tuple[str, str]], limit: int = K.CONTEXT_CHARS) -> str:
    """The newest pairs that fit, oldest first; the newest one always stays."""
    kept: list[str] = []
    room = limit
    for source, target in reversed(pairs):
        chunk = f"SOURCE: {source}\nTRANSLATION: {target}"
        room -= len(chunk)
        if kept and room < 0:
            break
        kept.append(chunk)
    return K.CONTEXT_DIVIDER.join(reversed(kept)) if kept else K.NO_CONTEXT


def prompt_of(settings: Prompting, segments: Sequence[dict], context: str, glossary: Sequence[str]) -> str:
    """The template with every marker filled, in the fixed order."""
    spoken = settings.source_language
    values = asdict(settings) | {
        "source_language": K.AUTO_LANGUAGE_TEXT if spoken.strip().lower() in K.AUTO_LANGUAGE_WORDS else spoken,
        "glossary_data": "\n".join(glossary) or K.NO_GLOSSARY,
        "document_instructions": settings.document_instructions or K.NO_CONTEXT, "prev_context": context,
        "text_segments": K.SEGMENT_DIVIDER.join(f"SEGMENT_ID: {s['seg_id']}\nTEXT:\n{s['text']}" for s in segments),
    }
    out = settings.template
    for marker in K.PROMPT_MARKERS:
        out = out.replace("{{" + marker + "}}", values[marker])
    return out


def map_prompted(batches: DataFrame, make_mapper: Callable[[], PromptedMapper], keys: Sequence[str], settings: Prompting,
                 terms: dict[str, str] | None = None) -> DataFrame:
    """keys, segments -> keys, segments, pairs, error; the batches of a document follow each other, from number 0."""
    source = batches.select(*keys, "segments")
    element = T.StructType.fromDDL(f"p {PAIRS}")["p"].dataType
    schema = T.StructType([*source.schema.fields, T.StructField("pairs", element), T.StructField("error", T.StringType())])
    finder = TermFinder(terms)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mapper, said = make_mapper(), []  # pairs of the document at hand

        def ask(segments: Sequence[dict]) -> str:
            glossary = [f"{s} => {t}" for s, t in finder.within("\n".join(s["source"] for s in segments))]
            shown = [(a[:K.CONTEXT_SIDE_CHARS], b[:K.CONTEXT_SIDE_CHARS]) for a, b in said[-K.CONTEXT_PAIRS:]]
            prompt = prompt_of(settings, segments, context_text(shown), glossary)
            return mapper({"segments": segments, "context": shown, "glossary": glossary, "prompt": prompt})

        for part in parts:
            pairs, errors = [], []
            for batch_id, segments in zip(part["batch_id"], part["segments"]):
                if batch_id == 0:
                    said.clear()
                found, failures = _answer_pairs(ask, list(segments))
                pairs.append(found)
                errors.append("; ".join(failures) or None)
                by_id = {p["segment_id"]: p["translated_text"] for p in found}
                for n, s in enumerate(segments):
                    told = found[n]["translated_text"] if len(found) == len(segments) else by_id.get(s["seg_id"])
                    if told:
                        said.append((s["source"], told))
                del said[:-K.CONTEXT_PAIRS]
            yield part.assign(pairs=pairs, error=errors)

    return source.mapInPandas(run, schema)


def translate_prompted(documents: DataFrame, make_mapper: Callable[[], PromptedMapper], settings: Prompting,
                       terms: dict[str, str] | None = None, key: str = "doc_id", options: plan.Options = plan.Options()) -> DataFrame:
    """Like ``translate``; the mapper gets a request with segments, context pairs, glossary lines and the prompt."""
    used = terms if options.glossary else None
    batches = plan.document_batches(plan.protected_documents(documents, used, key, placeholders=options.placeholders), key)
    answered = map_prompted(batches, make_mapper, [key, "batch_id"], settings, used)
    return plan.finished(answered, key, settings.target_language, options)
