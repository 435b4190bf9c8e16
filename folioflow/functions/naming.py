"""Progress in file names: range tokens, stems, resume names, page specs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow import constants as K
from folioflow.functions.text import strip

RANGES = "array<struct<first:int,last:int>>"


def page_spec(spec: Column, page_count: Column) -> Column:
    """Sorted 0-based pages of ``1-3,7`` within the document; NULL for an empty spec."""
    parts = F.filter(F.transform(F.split(spec, ","), strip), lambda p: p != "")

    def pages(part: Column) -> Column:
        first = strip(F.substring_index(part, "-", 1)).cast("int")
        dash = part.contains("-")
        last = F.when(
            dash, strip(F.substr(part, F.instr(part, "-") + F.lit(1))).cast("int")
        ).otherwise(first)
        # clip before expanding, so that a huge bound stays cheap
        lo = F.greatest(first - 1, F.lit(0))
        hi = F.least(last - 1, page_count - 1)
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))

    found = F.array_sort(F.array_distinct(F.flatten(F.transform(parts, pages))))
    return F.when(spec.isNotNull() & (spec != ""), found)


def _padded(n: Column) -> Column:
    return F.format_string("%03d", n)


def _span(first: Column, last: Column) -> Column:
    return F.concat(_padded(first), F.lit("-"), _padded(last))


def _listed(tag: str, ranges: Column) -> Column:
    shown = F.array_join(F.transform(ranges, lambda r: _span(r["first"], r["last"])), "_")
    return F.concat(F.lit(f"_{tag}_"), F.when(F.size(ranges) == 0, "000-000").otherwise(shown))


def _compact(tag: str, count: Column, low: Column, high: Column) -> Column:
    shown = F.concat(_span(low, high), F.lit("-MULTI"), count)
    return F.concat(F.lit(f"_{tag}_"), F.when(count == 0, "000-000").otherwise(shown))


def output_stem(base: Column, done: Column, left: Column) -> Column:
    """STRUCT<stem, needs_sidecar>.

    ``done`` and ``left`` are STRUCT<count, low, high, ranges>; ``ranges`` only
    has to be complete while the count is small enough to be listed.
    """
    def listed(done_tag: str, left_tag: str) -> Column:
        return F.concat(
            base, _listed(done_tag, done["ranges"]), _listed(left_tag, left["ranges"])
        )

    full = listed("translated", "untranslated")
    short = listed("T", "unT")
    tail = F.concat(
        _compact("translated", done["count"], done["low"], done["high"]),
        _compact("untranslated", left["count"], left["low"], left["high"]),
    )
    compact = F.concat(base, tail)
    hashed = F.concat(
        F.substring(base, 1, K.HASHED_BASE_CHARS), F.lit("_"),
        F.substring(F.sha1(base), 1, 8), tail,
    )
    few = (done["count"] <= K.LISTED_RANGES) & (left["count"] <= K.LISTED_RANGES)
    fits_full = few & (F.length(full) <= K.FULL_STEM_CHARS)
    fits_short = few & (F.length(short) <= K.SHORT_STEM_CHARS)
    return F.struct(
        F.when(fits_full, full)
        .when(fits_short, short)
        .when(F.length(compact) > K.COMPACT_STEM_CHARS, hashed)
        .otherwise(compact)
        .alias("stem"),
        (~(fits_full | fits_short)).alias("needs_sidecar"),
    )


def parse_ranges(c: Column) -> Column:
    """STRUCT<ranges, compact> of ``010-020_030-034`` or ``010-090-MULTI12``."""
    tokens = F.filter(F.split(c, "_"), lambda p: p.rlike(rf"\A{K.RANGE_TOKEN}\z"))
    return F.struct(
        F.transform(
            tokens,
            lambda p: F.struct(
                F.substring(p, 1, 3).cast("int").alias("first"),
                F.substring(p, 5, 3).cast("int").alias("last"),
            ),
        ).alias("ranges"),
        F.exists(tokens, lambda p: p.contains("-MULTI")).alias("compact"),
    )


def parse_resume_name(stem: Column) -> Column:
    """STRUCT of a resumable stem; NULL for other names.

    ``done`` and ``left`` are NULL when the name only holds a compact summary.
    """
    parts = [F.regexp_extract(stem, K.RESUME_NAME, i) for i in (1, 2, 3)]
    done, left = parse_ranges(parts[1]), parse_ranges(parts[2])
    none = F.array().cast(RANGES)

    def ranges(parsed: Column) -> Column:
        r = parsed["ranges"]
        blank = (F.size(r) == 1) & (r[0]["first"] == 0) & (r[0]["last"] == 0)
        return F.when(blank, none).otherwise(r)

    unresolved = done["compact"] | left["compact"]
    scope = ranges(done)
    return F.when(
        stem.rlike(K.RESUME_NAME),
        F.struct(
            parts[0].alias("base"),
            F.when(~unresolved, scope).alias("done"),
            F.when(~unresolved, ranges(left)).alias("left"),
            F.coalesce(F.try_element_at(scope, F.lit(1))["first"], F.lit(0)).alias("first_page"),
            F.coalesce(F.try_element_at(scope, F.lit(-1))["last"], F.lit(0)).alias("last_page"),
            unresolved.alias("unresolved"),
        ),
    )


def sidecar_path(path: Column) -> Column:
    """The progress file beside an output: its last suffix becomes ``.progress.json``."""
    folder = F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    stem = F.regexp_replace(name, r"(.)\.[^.]*$", "$1")
    return F.concat(folder, stem, F.lit(".progress.json"))
