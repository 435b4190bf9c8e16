"""Writing-system checks on recognised or mapped text."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow import constants as K
from folioflow.functions.binding import let
from folioflow.functions.text import is_label, strip


def _codes(lang: Column) -> Column:
    spec = F.when(lang.isNull() | (lang == ""), F.lit("eng")).otherwise(F.lower(lang))
    return F.split(spec, r"\+")


def _wants(lang: Column) -> dict[str, Column]:
    codes = _codes(lang)
    return {
        "japanese": F.arrays_overlap(codes, F.array(F.lit("jpn"), F.lit("jpn_vert"))),
        "korean": F.array_contains(codes, "kor"),
        "latin": F.array_contains(codes, "eng"),
    }


def plausibility(text: Column, lang: Column) -> Column:
    """STRUCT<ok, ratio, reason>: does the text use the scripts its language expects?"""
    wants = _wants(lang)
    names = list(wants)

    def per_language(value: Callable[[list], Column]) -> Column:
        out = F
        for choice in product([True, False], repeat=len(names)):
            picked = [n for n, used in zip(names, choice) if used] or ["other"]
            applies = reduce(
                lambda a, b: a & b,
                [wants[n] if used else ~wants[n] for n, used in zip(names, choice)],
            )
            out = out.when(applies, value([K.SCRIPT_RULES[n] for n in picked]))
        return out

    share = per_language(lambda rules: F.lit(min(r[1] for r in rules)))
    least = per_language(lambda rules: F.lit(min(r[2] for r in rules)))

    def hits(compact: Column) -> Column:
        return per_language(
            lambda rules: F.length(
                F.regexp_replace(compact, f"[^{''.join(r[0] for r in rules)}]", "")
            )
        )

    def verdict(n: Column, size: Column) -> Column:
        ratio = F.when(size == 0, F.lit(0.0)).otherwise(n / size)
        return F.struct(
            ((size > 0) & (n >= least) & (ratio >= share)).alias("ok"),
            ratio.alias("ratio"),
            F.when(size == 0, "empty")
            .otherwise(F.concat(F.lit("script="), n, F.lit("/"), size)).alias("reason"),
        )

    compact = F.regexp_replace(F.coalesce(text, F.lit("")), K.JAVA_SPACE, "")
    counts = let(compact, lambda c: F.struct(hits(c).alias("hits"), F.length(c).alias("size")))
    return let(counts, lambda c: verdict(c["hits"], c["size"]))


def script_rule(lang: Column) -> Column:
    """STRUCT<chars, share, least> of a recognition code: computed once, it serves many texts (``follows``)."""
    wants, names, out = _wants(lang), list(_wants(lang)), F
    for choice in product([True, False], repeat=len(names)):
        rules = [K.SCRIPT_RULES[n] for n in ([n for n, used in zip(names, choice) if used] or ["other"])]
        applies = reduce(lambda a, b: a & b, [wants[n] if used else ~wants[n] for n, used in zip(names, choice)])
        out = out.when(applies, F.struct(
            F.lit(f"[^{''.join(r[0] for r in rules)}]").alias("others"), F.lit(min(r[1] for r in rules)).alias("share"),
            F.lit(min(r[2] for r in rules)).alias("least")))
    return out


def follows(text: Column, rule: Column) -> Column:
    """``plausibility(text, lang)["ok"]`` for a rule that is at hand."""
    compact = F.regexp_replace(F.coalesce(text, F.lit("")), K.JAVA_SPACE, "")
    counts = let(compact, lambda c: F.struct(
        F.length(F.regexp_replace(c, rule["others"], F.lit(""))).alias("hits"), F.length(c).alias("size")))
    return let(counts, lambda c: (c["size"] > 0) & (c["hits"] >= rule["least"]) & (c["hits"] / c["size"] >= rule["share"]))


def sanitize_recognised(text: Column, lang: Column) -> Column:
    """For Japanese without English: drop Latin runs, foreign signs and blanks."""
    wants = _wants(lang)
    t = strip(F.coalesce(text, F.lit("")))
    japanese = F.regexp_replace(t, "[A-Za-z]{2,}", "")
    japanese = F.regexp_replace(japanese, K.JAPANESE_KEPT, "")
    japanese = F.regexp_replace(japanese, K.JAVA_SPACE, "")
    return F.when(wants["japanese"] & ~wants["latin"], japanese).otherwise(t)


def ocr_code(lang: Column, explicit: Column | None = None) -> Column:
    """Recognition code of a language name; NULL when unknown."""
    table = F.create_map(*[F.lit(x) for kv in K.OCR_CODES.items() for x in kv])
    known = F.try_element_at(table, F.lower(strip(F.coalesce(lang, F.lit("")))))
    if explicit is None:
        return known
    return F.when(explicit != "", explicit).otherwise(known)


def target_script(lang: Column) -> Column:
    """Character class of the target language's own script; NULL when it has none."""
    name = F.lower(strip(F.coalesce(lang, F.lit(""))))
    out = F.when(F.lit(False), F.lit(""))
    for charset, names in K.TARGET_SCRIPTS.items():
        out = out.when(name.isin(*names), F.lit(charset))
    return out


def lacks_target_script(text: Column, lang: Column) -> Column:
    name = F.lower(strip(F.coalesce(lang, F.lit(""))))
    out = F.when(F.lit(False), F.lit(False))
    for charset, names in K.TARGET_SCRIPTS.items():
        out = out.when(name.isin(*names), ~text.rlike(charset))
    return out.otherwise(F.lit(False))


def is_echo(source: Column, mapped: Column, lang: Column) -> Column:
    """Long enough output for a long enough source without one target-script sign."""
    out = strip(mapped)
    letters = F.length(F.regexp_replace(source, r"[^\p{L}]", ""))
    return (
        (F.length(out) >= K.ECHO_MIN_CHARS)
        & (letters >= K.ECHO_MIN_LETTERS)
        & lacks_target_script(out, lang)
    )


def is_plausible_pair(source: Column, mapped: Column) -> Column:
    """Reject label -> long text and paragraph -> label."""
    src, out = strip(source), strip(mapped)
    label = is_label(src)
    label_reply = (F.length(out) <= K.LABEL_REPLY_CHARS) & ~out.rlike(K.LABEL_REPLY_STOPS)
    swollen = label & ~label_reply & (F.length(out) > F.length(src) * K.LABEL_GROWTH)
    shrunk = ~label & (F.length(src) > K.PARAGRAPH_CHARS) & label_reply
    return (src != "") & (out != "") & ~swollen & ~shrunk
