"""Text expressions: trimming, cleaning, segment lines and their predicates."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow import constants as K
from folioflow.functions.arrow import arrow_batched


def strip(c: Column) -> Column:
    """Trim Unicode whitespace on both sides."""
    return F.btrim(c, F.lit(K.SPACE_CHARS))


def _clean(c: Column, dash_run: str) -> Column:
    c = F.regexp_replace(c, K.DASH_LIKE, "-")
    c = F.regexp_replace(c, K.DROPPED_CONTROLS, "")
    c = F.regexp_replace(c, f"(?U){dash_run}*-{dash_run}*", " - ")
    return F.regexp_replace(c, r"[ \t]+", " ")


def clean_characters(c: Column) -> Column:
    """Stray glyphs to dashes, dash runs to ' - ', blanks collapsed, trimmed."""
    return strip(_clean(c, f"[-+{K.JAVA_SPACE_SET}]"))


def segment_lines(c: Column) -> Column:
    """The cleaned, non-blank lines of a text, in order.

    The patterns run over the whole text, with a class that excludes the line
    feed, which equals cleaning line by line but stays in generated code. Only
    the trimming happens per line.
    """
    cleaned = _clean(c, f"[-+{K.JAVA_SPACE_SET}&&[^\\n]]")
    return F.filter(F.transform(F.split(cleaned, "\n"), strip), lambda t: t != "")


def has_letter(c: Column) -> Column:
    return c.rlike(K.LETTER)


def is_label(c: Column) -> Column:
    """A short one-line text that ends with a colon."""
    t = strip(c)
    return (
        (t != "")
        & ~t.contains("\n")
        & (F.length(t) <= K.LABEL_MAX_CHARS)
        & (t.endswith(K.LABEL_ENDINGS[0]) | t.endswith(K.LABEL_ENDINGS[1]))
    )


def ends_sentence(c: Column) -> Column:
    return F.right(strip(c), F.lit(1)).isin(*K.SENTENCE_END_CHARS)


def tidy_lines(c: Column) -> Column:
    """Unify line ends, collapse blanks and trim every line and the whole."""
    c = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    c = F.regexp_replace(c, r"[ \t]+", " ")
    return strip(F.array_join(F.transform(F.split(c, "\n"), strip), "\n"))


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / 4).cast("int")


def word_cost(c: Column) -> Column:
    return token_estimate(c) + 1


def words(c: Column) -> Column:
    """Whitespace-separated words; none for a blank text."""
    t = strip(c)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(
        F.split(t, f"{K.JAVA_SPACE}+")
    )


def occurrences(c: Column, needle: str) -> Column:
    """Non-overlapping count of a literal."""
    return (
        (F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))) / len(needle)
    ).cast("int")


_STRAIGHT = str.maketrans({"“": '"', "”": '"', "‘": "'", "’": "'", "（": "(", "）": ")"})
_SENTENCE_START = re.compile(r"(?<=[.!?])(\s+)([a-z])")


def normalize_one(text: str | None) -> str | None:
    """Compatibility forms, straight quotes, spacing, blank lines, capitals."""
    if not text:
        return text
    out = unicodedata.normalize("NFKC", text).translate(_STRAIGHT)
    out = re.sub(r"[ \t]+", " ", out)
    out = re.sub(r" (?=[.,!?])", "", out)
    out = re.sub(r"\n\n\n+", "\n\n", out)
    return _SENTENCE_START.sub(lambda m: m[1] + m[2].upper(), out).strip()


@arrow_batched("string")
def normalize(texts: pd.Series) -> pd.Series:
    return texts.map(normalize_one)
