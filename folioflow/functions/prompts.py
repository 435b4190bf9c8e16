"""Prompt text built from segments, context pairs and settings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow import constants as K
from folioflow.functions.binding import let
from folioflow.functions.services import source_language


def mock_mapping(text: Column) -> Column:
    return F.concat(F.lit(K.MOCK_PREFIX), text)


def segments_block(segments: Column) -> Column:
    """Render ARRAY<STRUCT<seg_id, text>> as one prompt block."""
    return F.array_join(
        F.transform(
            segments,
            lambda s: F.concat(F.lit("SEGMENT_ID: "), s["seg_id"], F.lit("\nTEXT:\n"), s["text"]),
        ),
        K.SEGMENT_DIVIDER,
    )


def context_block(pairs: Column, limit: int = K.CONTEXT_CHARS) -> Column:
    """Render the newest of ARRAY<STRUCT<source, target>> that fit, oldest first.

    Chunks are taken from the newest backwards while the characters stay within
    ``limit``; the newest one is always kept. The array is short by contract
    (the rolling context holds a dozen pairs), so the suffix sums are cheap.
    """
    rendered = F.transform(
        pairs,
        lambda p: F.concat(F.lit("SOURCE: "), p["source"], F.lit("\nTRANSLATION: "), p["target"]),
    )

    def newest(chunks: Column) -> Column:
        n = F.size(chunks)

        def size_from(i: Column) -> Column:
            return F.aggregate(
                F.slice(chunks, i + 1, n), F.lit(0), lambda acc, c: acc + F.length(c)
            )

        return F.filter(chunks, lambda c, i: (i == n - 1) | (size_from(i) <= limit))

    return F.when(F.size(pairs) == 0, F.lit(K.NO_CONTEXT)).otherwise(
        F.array_join(let(rendered, newest), K.CONTEXT_DIVIDER)
    )


def fill_markers(template: Column, values: dict[str, Column]) -> Column:
    """Replace ``{{marker}}`` texts one after the other, in the fixed order."""
    out = template
    for marker in K.PROMPT_MARKERS:
        out = F.replace(out, F.lit("{{" + marker + "}}"), values[marker])
    return out


def user_prompt(template: Column, *, source_lang: Column, target_lang: Column, glossary: Column,
                context: Column, segments: Column, settings: dict[str, Column]) -> Column:
    """The user prompt of one batch."""
    def filled(c: Column, default: str) -> Column:
        return F.when(c.isNull() | (c == ""), F.lit(default)).otherwise(c)

    return fill_markers(
        template,
        {
            "source_language": source_language(source_lang),
            "target_language": target_lang,
            "document_type": settings["doc_type"],
            "translation_style": settings["style"],
            "terminology_policy": settings["terminology"],
            "glossary_data": filled(glossary, K.NO_GLOSSARY),
            "document_title": settings["title"],
            "document_domain": settings["domain"],
            "document_instructions": filled(settings["instructions"], K.NO_CONTEXT),
            "prev_context": context,
            "text_segments": segments_block(segments),
        },
    )


def substitute(template: Column, values: dict[str, Column]) -> Column:
    """``$name`` / ``${name}`` substitution that leaves unknown names alone.

    The template is cut into literal and placeholder parts first, so that a
    value holding a dollar sign is never substituted again.
    """
    part = r"\$\$|\$\{[_a-zA-Z][_a-zA-Z0-9]*\}|\$[_a-zA-Z][_a-zA-Z0-9]*|[^$]+|\$"
    table = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])

    def fill(p: Column) -> Column:
        name = F.regexp_extract(p, r"\A\$\{?([_a-zA-Z][_a-zA-Z0-9]*)\}?\z", 1)
        return F.when(p == "$$", F.lit("$")).otherwise(
            F.coalesce(F.when(name != "", F.try_element_at(table, name)), p)
        )

    return F.array_join(
        F.transform(F.regexp_extract_all(template, F.lit(part), F.lit(0)), fill), ""
    )
