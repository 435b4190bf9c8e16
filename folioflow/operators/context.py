"""Context around batches: rolling pairs and document samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow import constants as K
from folioflow.functions.text import strip


def rolling_pairs(pairs: Column, start: Column, window: int = K.CONTEXT_PAIRS) -> Column:
    """The last pairs before a 1-based position, both sides cut, oldest first.

    ``pairs`` is a document's ARRAY<STRUCT<source, target>>; the pairs sit in
    the row, so looking back needs no window.
    """
    first = F.greatest(start - window, F.lit(1))
    return F.transform(
        F.slice(pairs, first, F.greatest(start - first, F.lit(0))),
        lambda p: F.struct(
            F.substring(p["source"], 1, K.CONTEXT_SIDE_CHARS).alias("source"),
            F.substring(p["target"], 1, K.CONTEXT_SIDE_CHARS).alias("target"),
        ),
    )


def sample(texts: Column, limit: int = K.SAMPLE_CHARS) -> Column:
    """The first texts of a document, joined until they exceed the limit, cut and trimmed.

    The sample is the feature: it is what a document classifier gets to see.
    """
    grown = F.aggregate(
        texts,
        F.lit(""),
        lambda acc, t: F.when(F.length(acc) > limit, acc).otherwise(F.concat(acc, t, F.lit("\n"))),
    )
    return strip(F.substring(grown, 1, limit))


def context_reply(reply: Column) -> Column:
    """Category named by a classifier's JSON reply; ``default`` for anything else."""
    bare = F.regexp_replace(strip(reply), r"\A```(?:json)?|```\z", "")
    named = F.lower(F.get_json_object(strip(bare), "$.context"))
    out = F.when(F.lit(False), F.lit(""))
    for category in K.CONTEXT_CATEGORIES:
        out = out.when(named == category.lower(), category)
    return out.otherwise("default")
