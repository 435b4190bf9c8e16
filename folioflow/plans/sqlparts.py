"""Fragments of the SQL checks. They state each rule on its own, line by line."""

from __future__ import annotations

from folioflow import constants as K

NL = "chr(10)"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(expr: str, pattern: str, by: str) -> str:
    return f"regexp_replace({expr}, {quoted(pattern)}, {quoted(by)}, 'g')"


def strip(expr: str) -> str:
    return sub(expr, K.EDGE_SPACE, "")


def clean(expr: str) -> str:
    out = sub(sub(expr, K.DASH_LIKE, "-"), K.DROPPED_CONTROLS, "")
    out = sub(out, f"[-+{K.SPACE_SET}]*-[-+{K.SPACE_SET}]*", " - ")
    return strip(sub(out, r"[ \t]+", " "))


def hit(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {quoted(pattern)})"


def label(expr: str) -> str:
    t = strip(expr)
    return (
        f"({t} <> '' AND NOT contains({t}, {NL}) AND length({t}) <= {K.LABEL_MAX_CHARS}"
        f" AND (ends_with({t}, ':') OR ends_with({t}, '：')))"
    )


def lines(source: str, keys: str, name: str = "ls") -> str:
    """CTEs that cut the text of ``source`` into cleaned non-blank lines numbered from 0."""
    return f"""
{name}_raw AS (
  SELECT {keys}, unnest(string_split(text, {NL})) AS l,
    generate_subscripts(string_split(text, {NL}), 1) AS i FROM {source}),
{name}_clean AS (SELECT {keys}, i, {clean('l')} AS text FROM {name}_raw),
{name} AS (
  SELECT {keys}, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY i) - 1 AS INTEGER) AS pos, text
  FROM {name}_clean WHERE text <> '')"""


SEGMENTS = lines("documents", "doc_id") + f""",
segs AS (
  SELECT doc_id, pos, CAST(pos // 10 AS INTEGER) AS page, pos % 10 AS block,
    printf('page_%03d_block_%03d', pos // 10 + 1, pos % 10) AS seg_id, text,
    {hit('text', K.LETTER)} AS needs
  FROM ls)"""

TALK = lines("conversations", "conv_id, turn", "tl") + f""",
talk AS (
  SELECT conv_id, turn, 0 AS sub, role || ':' AS text FROM conversations
  UNION ALL SELECT conv_id, turn, pos + 1, text FROM tl)"""


def greedy(source: str, key: str, max_chars: int, max_rows: int) -> str:
    """Recursive CTE over (key, idx, size, kind): one step per row, exactly the cut rule."""
    cut = f"(b.chars + t.size > {max_chars} OR b.cnt >= {max_rows} OR b.kind <> t.kind)"
    return f"""
packed AS (
  SELECT {key}, idx, size AS chars, CAST(1 AS BIGINT) AS cnt, kind, CAST(0 AS BIGINT) AS batch_id
  FROM {source} WHERE idx = 0
  UNION ALL
  SELECT t.{key}, t.idx, CASE WHEN {cut} THEN t.size ELSE b.chars + t.size END,
    CASE WHEN {cut} THEN 1 ELSE b.cnt + 1 END, t.kind,
    b.batch_id + CASE WHEN {cut} THEN 1 ELSE 0 END
  FROM packed b JOIN {source} t ON t.{key} = b.{key} AND t.idx = b.idx + 1)"""


def targets(length: str = "length(text)") -> str:
    return f"""
tgt AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS idx,
    {length} AS size, {label('text')} AS kind, text
  FROM segs WHERE needs)"""


def capitals(expr: str) -> str:
    """Upper-case the ASCII letter after a sentence end, one letter at a time."""
    for c in "abcdefghijklmnopqrstuvwxyz":
        expr = sub(expr, rf"([.!?]{K.SPACE}+){c}", rf"\1{c.upper()}")
    return expr


def y_overlap(a: str, b: str) -> str:
    shared = f"(least({a}y1, {b}y1) - greatest({a}y0, {b}y0))"
    lower = f"least({a}y1 - {a}y0, {b}y1 - {b}y0)"
    return f"CASE WHEN {shared} <= 0 THEN 0.0::DOUBLE ELSE {shared} / greatest({lower}, 1e-6) END"


def gap(a: str, b: str, axis: str) -> str:
    return f"greatest({b}{axis}0 - {a}{axis}1, {a}{axis}0 - {b}{axis}1, 0.0::DOUBLE)"


def overlap_area(a: str, b: str) -> str:
    w = f"(least({a}x1, {b}x1) - greatest({a}x0, {b}x0))"
    h = f"(least({a}y1, {b}y1) - greatest({a}y0, {b}y0))"
    return f"CASE WHEN {w} <= 0 OR {h} <= 0 THEN 0.0::DOUBLE ELSE {w} * {h} END"


def protected(source: str, keys: str, name: str = "prot") -> str:
    """CTEs that swap literals one at a time: text ``t`` with numbered tokens and list ``raws``."""
    patterns = ", ".join(
        quoted(pattern.replace(r"\s<", K.SPACE_SET + "<")) for _, pattern in K.PROTECTED_PATTERNS
    )
    return f"""
pats AS (SELECT [{patterns}] AS ps),
swaps AS (
  SELECT {keys}, text AS src, text AS t, 1 AS k, 0 AS n, []::VARCHAR[] AS raws FROM {source}
  UNION ALL
  SELECT {keys}, src, CASE WHEN m THEN regexp_replace(t, p, '⟦PH' || n || '⟧') ELSE t END,
    CASE WHEN m THEN k ELSE k + 1 END, CASE WHEN m THEN n + 1 ELSE n END,
    CASE WHEN m THEN list_append(raws, regexp_extract(t, p)) ELSE raws END
  FROM (SELECT swaps.*, ps[k] AS p, regexp_matches(t, ps[k]) AS m FROM swaps, pats
    WHERE k <= {len(K.PROTECTED_PATTERNS)})),
{name} AS (SELECT {keys}, src, t, n, raws FROM swaps WHERE k = {len(K.PROTECTED_PATTERNS) + 1})"""


def restored(source: str, keys: str, text: str, name: str = "back") -> str:
    """CTEs that put the literals back, the latest token first: text ``z``."""
    return f"""
puts AS (
  SELECT {keys}, src, {text} AS z, raws, len(raws) AS i FROM {source}
  UNION ALL
  SELECT {keys}, src, replace(z, '⟦PH' || (i - 1) || '⟧', raws[i]), raws, i - 1 FROM puts WHERE i > 0),
{name} AS (SELECT {keys}, src, z FROM puts WHERE i = 0)"""


def normalized(expr: str) -> str:
    """Spacing, blank lines and capitals; the given texts hold no compatibility forms."""
    out = sub(sub(expr, r"[ \t]+", " "), r" ([.,!?])", r"\1")
    return strip(capitals(sub(out, r"\n{3,}", "\n\n")))
