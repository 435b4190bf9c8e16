"""Placeholder tokens: protect literals before mapping, check and restore after.

Numbering tokens depends on every earlier match, so protect and restore are
Arrow-batched helpers; all checks on tokens are native expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow import constants as K
from folioflow.functions.arrow import arrow_batched
from folioflow.functions.binding import let

# ``held`` and ``terms`` list what the tokens numbered 0, 1, 2, ... stand for
PROTECTED_TYPE = "struct<text:string, held:array<string>, terms:array<string>>"
RESTORED_TYPE = "struct<text:string, error:string>"

_RULES = [(sign, re.compile(pattern)) for sign, pattern in K.PROTECTED_PATTERNS]
_TICKS = next(rule for _, rule in _RULES if rule.pattern == r"`[^`\n]+`")
_LITERAL = re.compile(r"⟦PH[0-9]+⟧")
_TERM = re.compile(r"⟦GL[0-9]+⟧")


def protect_one(text: str, terms: Sequence[tuple[str, str]] = ()) -> dict:
    """Swap glossary terms, then literals, for numbered tokens.

    ``terms`` come longest first; they are searched in what is left of the
    text, never inside a token. Literals are swapped pattern by pattern, each
    time the first one in the text.
    """
    held: list[str] = []
    targets: list[str] = []
    parts = [text]  # text and tokens in turn
    for source, target in terms:
        if source not in text:
            continue
        cut: list[str] = []
        for n, part in enumerate(parts):
            if n % 2:
                cut.append(part)
                continue
            first, *rest = part.split(source)
            cut.append(first)
            for piece in rest:
                cut += [K.TOKEN_FORMAT % ("GL", len(targets)), piece]
                targets.append(target)
        parts = cut
    text = "".join(parts)
    for sign, rule in _RULES:
        if sign not in text:
            continue
        if rule is _TICKS:
            text = "\n".join(_swap_ticks(line, held) if sign in line else line for line in text.split("\n"))
        else:
            text = rule.sub(lambda found: _hold(found[0], held), text)
    return {"text": text, "held": held, "terms": targets}


def _hold(raw: str, held: list[str]) -> str:
    held.append(raw)
    return K.TOKEN_FORMAT % ("PH", len(held) - 1)


def _swap_ticks(line: str, held: list[str]) -> str:
    """Swap code spans of a line. Only here can a swap complete an earlier match: ticks
    right before a span open nothing while another tick follows, and may open one once
    the span is a token. All other patterns go on behind the token."""
    out: list[str] = []
    at = 0
    while found := _TICKS.search(line, at):
        start, end = found.span()
        token = _hold(found[0], held)
        if start > at and line[start - 1] == "`":
            ticks = start
            while ticks > at and line[ticks - 1] == "`":
                ticks -= 1
            out.append(line[at:ticks])
            line, at = line[ticks:start] + token + line[end:], 0
        else:
            out += [line[at:start], token]
            at = end
    return "".join([*out, line[at:]])


def restore_one(text: str | None, held, terms) -> dict:
    """Put literals back, latest token first, then glossary targets."""
    if text is None:
        return {"text": None, "error": None}
    literals = [(K.TOKEN_FORMAT % ("PH", n), raw) for n, raw in enumerate(held)]
    targets = [(K.TOKEN_FORMAT % ("GL", n), raw) for n, raw in enumerate(terms)]
    checks = (
        (reversed(literals), _LITERAL, "placeholder"), (targets, _TERM, "glossary placeholder"),
    )
    for pairs, leftover, kind in checks:
        for token, raw in pairs:
            if token not in text:
                return {"text": None, "error": f"missing {kind} {token}"}
            text = text.replace(token, raw)
        stray = leftover.search(text)
        if stray:
            return {"text": None, "error": f"unresolved {kind} {stray[0]}"}
    return {"text": text, "error": None}


def token_map(kind: str, raws: Column) -> Column:
    """MAP<token, raw> of listed raws, for storing beside a text."""
    return F.map_from_entries(F.transform(
        raws, lambda raw, n: F.struct(F.format_string(K.TOKEN_FORMAT, F.lit(kind), n), raw)
    ))


def from_token_map(mapping: Column) -> Column:
    """The raws of a stored map, in token order."""
    number = F.transform(
        F.map_entries(mapping),
        lambda e: F.struct(F.regexp_extract(e["key"], r"([0-9]+)", 1).cast("int"), e["value"].alias("raw")),
    )
    return F.transform(F.array_sort(number), lambda e: e["raw"])


def longest_first(terms: dict[str, str]) -> list[tuple[str, str]]:
    """Non-empty terms by falling length; equal lengths keep their order."""
    return sorted(((s, t) for s, t in terms.items() if s), key=lambda p: -len(p[0]))


class TermFinder:
    """Which of the terms, longest first, occur in a text? One pass over the text, by an automaton per task."""

    def __init__(self, terms: dict[str, str] | None):
        self.ordered = longest_first(terms or {})
        self._automaton = None

    def __getstate__(self):
        return {"ordered": self.ordered, "_automaton": None}

    def within(self, text: str) -> list[tuple[str, str]]:
        if not self.ordered:
            return []
        if self._automaton is None:
            self._automaton = term_automaton(s for s, _ in self.ordered)
            self._place = {s: n for n, (s, _) in enumerate(self.ordered)}
        found = {source for _, source in self._automaton.iter(text)}
        return [self.ordered[n] for n in sorted(self._place[s] for s in found)]


def term_automaton(sources: Iterable[str]):
    """An automaton that reports every occurrence of every source; sources are not empty."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for source in sources:
        automaton.add_word(source, source)
    automaton.make_automaton()
    return automaton


def protector(terms: dict[str, str] | None = None) -> Callable[[Column], Column]:
    """Protect with a glossary that the driver holds."""
    finder = TermFinder(terms)

    @arrow_batched(PROTECTED_TYPE)
    def protect(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(
            [protect_one(t or "", finder.within(t or "")) for t in texts], columns=["text", "held", "terms"]
        )

    return protect


@arrow_batched(PROTECTED_TYPE)
def protect_with_terms(texts: pd.Series, terms: pd.Series) -> pd.DataFrame:
    """Protect with each row's own terms, an array of (source, target) longest first."""
    rows = [
        protect_one(t or "", [(p["source"], p["target"]) for p in (own if own is not None else ())])
        for t, own in zip(texts, terms)
    ]
    return pd.DataFrame(rows, columns=["text", "held", "terms"])


@arrow_batched(RESTORED_TYPE)
def restore(texts: pd.Series, held: pd.Series, terms: pd.Series) -> pd.DataFrame:
    rows = [restore_one(t, h, g) for t, h, g in zip(texts, held, terms)]
    return pd.DataFrame(rows, columns=["text", "error"])


def tokens_in(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(K.TOKEN), F.lit(0))


def _count_in(tokens: Column, token: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: t == token))


def _with_tokens(original: Column, mapped: Column, body: Callable[[Column, Column], Column]) -> Column:
    """Extract the tokens of both sides once, then compare."""
    both = F.struct(tokens_in(original).alias("before"), tokens_in(mapped).alias("after"))
    return let(both, lambda b: body(b["before"], b["after"]))


def token_faults(original: Column, mapped: Column) -> Column:
    """STRUCT<missing, duplicated, hallucinated>: token multiset differences, in text order."""

    def faults(before: Column, after: Column) -> Column:
        sent = F.array_distinct(before)
        return F.struct(
            F.filter(sent, lambda t: _count_in(after, t) < _count_in(before, t)).alias("missing"),
            F.filter(sent, lambda t: _count_in(after, t) > _count_in(before, t)).alias("duplicated"),
            F.array_except(after, before).alias("hallucinated"),
        )

    return _with_tokens(original, mapped, faults)


def token_error(original: Column, mapped: Column) -> Column:
    """First token fault in original order, then hallucinations; NULL when sound."""

    def fault(before: Column, after: Column) -> Column:
        off = F.filter(
            F.array_distinct(before), lambda t: _count_in(after, t) != _count_in(before, t)
        )
        first = F.try_element_at(off, F.lit(1))
        new = F.try_element_at(F.array_except(after, before), F.lit(1))
        kind = F.when(_count_in(after, first) < _count_in(before, first), "missing ").otherwise(
            "duplicated "
        )
        return F.when(first.isNotNull(), F.concat(kind, first)).when(
            new.isNotNull(), F.concat(F.lit("hallucinated "), new)
        )

    return _with_tokens(original, mapped, fault)


def line_protector(terms: dict[str, str] | None = None) -> Callable[[Column], Column]:
    """Protect every text of an ARRAY<STRING>, each with its own numbering."""
    finder = TermFinder(terms)

    @arrow_batched(f"array<{PROTECTED_TYPE}>")
    def protect_lines(lines: pd.Series) -> pd.Series:
        return lines.map(lambda row: [protect_one(t, finder.within(t)) for t in row])

    return protect_lines
