"""Checks of finished text: stray tokens, fenced blocks, links, emphasis."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ElementTree
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow import constants as K
from folioflow.functions.arrow import arrow_batched


class _Balance(HTMLParser):
    """Keeps the stack of open elements and the first fault: the later ones may only follow from it."""

    def __init__(self) -> None:
        super().__init__()
        self.open: list[str] = []
        self.fault: str | None = None

    def handle_starttag(self, tag, attrs):
        if tag not in K.VOID_ELEMENTS:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if self.open and self.open[-1] == tag:
            self.open.pop()
        elif self.fault is None:
            self.fault = f"expected </{self.open[-1]}>, got </{tag}>" if self.open else f"</{tag}> without start"


def html_fault_one(html: str) -> str | None:
    walker = _Balance()
    try:
        walker.feed(html)
        walker.close()
    except (AssertionError, ValueError):  # what the parser raises on a broken declaration
        return "unreadable markup"
    if walker.fault:
        return walker.fault
    return f"unclosed {','.join(walker.open)}" if walker.open else None


@arrow_batched("string")
def html_fault(pages: pd.Series) -> pd.Series:
    """Balance fault of an HTML text; NULL when every element closes in order."""
    return pages.map(lambda h: None if h is None else html_fault_one(h))


def _json_fault(block: str) -> str | None:
    try:
        json.loads(block)
    except (json.JSONDecodeError, RecursionError):
        return "invalid json block"
    return None


def _xml_fault(block: str) -> str | None:
    try:
        ElementTree.fromstring(f"<root>{block}</root>")
    except (ElementTree.ParseError, ValueError, RecursionError):
        return "invalid xml block"
    return None


def _html_block_fault(block: str) -> str | None:
    return "invalid html block" if html_fault_one(block) else None


_FENCES = [
    (re.compile(rf"```{kind}\s*(.*?)\s*```", re.DOTALL), check)
    for kind, check in (("json", _json_fault), ("xml", _xml_fault), ("html", _html_block_fault))
]


def fence_fault_one(text: str | None) -> str | None:
    if not text or "```" not in text:
        return None
    for fence, check in _FENCES:
        for block in fence.findall(text):
            fault = check(block)
            if fault:
                return fault
    return None


@arrow_batched("string")
def fence_fault(texts: pd.Series) -> pd.Series:
    return texts.map(fence_fault_one)


def stray_token(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, K.TOKEN, 0), F.lit(""))


def has_open_link(c: Column) -> Column:
    """A Markdown link followed by a blank before its parenthesis closes.

    A title inside the parentheses counts as open too; that is the rule.
    """
    return c.rlike(K.OPEN_LINK)


def odd_asterisks(c: Column) -> Column:
    """A warning only: emphasis may be unclosed."""
    return (F.length(c) - F.length(F.replace(c, F.lit("*"), F.lit("")))) % 2 == 1


def markup_fault(c: Column, fence: Column) -> Column:
    """First fault of a finished text, given the fault of its fenced blocks; NULL when sound."""
    stray = stray_token(c)
    return F.coalesce(
        F.when(stray.isNotNull(), F.concat(F.lit("unresolved placeholder "), stray)),
        fence,
        F.when(has_open_link(c), F.lit("unclosed link")),
    )


def finished_fault(c: Column) -> Column:
    return markup_fault(c, fence_fault(c))


def structure_faults(original: Column, mapped: Column) -> Column:
    """ARRAY of structure faults: code fences and '#' signs must keep their number."""
    from folioflow.functions.text import occurrences

    return F.filter(
        F.array(
            F.when(occurrences(original, "```") != occurrences(mapped, "```"), "code fences differ"),
            F.when(occurrences(original, "#") != occurrences(mapped, "#"), "headers differ"),
        ),
        lambda f: f.isNotNull(),
    )


def content_faults(original: Column, mapped: Column) -> Column:
    """ARRAY: empty, or under a tenth of the source length."""
    from folioflow.functions.text import strip

    return F.filter(
        F.array(
            F.when(strip(mapped) == "", "empty")
            .when(F.length(mapped) < F.length(original) * 0.1, "too short")
        ),
        lambda f: f.isNotNull(),
    )


def recognition_warnings(text: Column, confidence: Column) -> Column:
    """ARRAY of warnings on recognised text."""
    return F.filter(
        F.array(
            F.when(F.coalesce(confidence, F.lit(1.0)) < 0.8, "low confidence"),
            F.when(text.isNull() | (text == ""), "empty region"),
        ),
        lambda f: f.isNotNull(),
    )
