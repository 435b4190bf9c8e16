"""Chat formatting from typed content parts. Native: DataFrame functions only.

A turn is a role and an array of parts (``PART``): text, image, audio, document, or
any other kind. Visiting the parts in order flattens them into one string: texts
are escaped, every attachment becomes the placeholder of its kind, and is recorded
with its place, reference and the number of tokens its placeholder expands to. So
the n-th placeholder of a formatted conversation is its n-th attachment.

Template (control strings in ``CONTROLS``)::

    <s> [INST] role [ROLE] parts [/INST] </s>  ...  parts </s>      without the blanks

An assistant's turn is its parts and ``</s>``; the loss mask covers its parts. Texts
and roles get a backslash inside every control string and before every backslash
of their own, so what marks a turn or a part never comes from a text, and
``read_chats`` gives back every role, part and text as it was.

Defined results: turns are ordered by turn number (null first), then role, then
content, so repeated rows stand next to each other and all stay; a null role or
text is empty; a null or empty list of parts is an empty turn; a part without a
kind counts as text; null parts are left out; rows without a conversation id form
one conversation; an empty table gives an empty table; columns besides the four
named ones never matter. A formatted conversation is one value and has to fit
into a row; turns are rendered before they are shuffled, once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEGIN, END, OPEN, ROLE, CLOSE = "<s>", "</s>", "[INST]", "[ROLE]", "[/INST]"
MARKERS = {"text": "[TEXT]", "image": "[IMAGE]", "audio": "[AUDIO]", "document": "[DOCUMENT]"}
#: Attachments of any other kind.
OTHER = "[FILE]"
CONTROLS = [BEGIN, END, OPEN, ROLE, CLOSE, *MARKERS.values(), OTHER]
ASSISTANT = "assistant"

PART = "struct<kind string, text string, ref string, width int, height int, seconds double, pages int>"
#: Side of an image patch in pixels, tokens of a second of audio and of a page.
PATCH, PER_SECOND, PER_PAGE = 28, 25, 256

_MARKER = "|".join(m.replace("[", r"\[").replace("]", r"\]") for m in [*MARKERS.values(), OTHER])


def _image(part: Column) -> Column:
    def patches(side: str) -> Column:
        return F.ceil(F.greatest(F.coalesce(part[side], F.lit(0)), F.lit(1)) / PATCH)

    return patches("width") * patches("height")


def _audio(part: Column) -> Column:
    seconds = F.nanvl(F.coalesce(part["seconds"], F.lit(0.0)), F.lit(0.0))
    return F.ceil(F.greatest(F.least(seconds, F.lit(1e12)), F.lit(0.0)) * PER_SECOND)


def _document(part: Column) -> Column:
    return F.greatest(F.coalesce(part["pages"], F.lit(0)), F.lit(1)) * F.lit(PER_PAGE).cast("long")


#: How many tokens the placeholder of a kind expands to.
EXPANDED: dict[str, Callable[[Column], Column]] = {"image": _image, "audio": _audio, "document": _document}


def escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for control in CONTROLS:
        out = F.replace(out, F.lit(control), F.lit(f"{control[0]}\\{control[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """The parts of a turn that is one text."""
    nothing = [F.lit(None).cast(t).alias(n) for n, t in
               (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *nothing))


def _kind(part: Column) -> Column:
    return F.coalesce(part["kind"], F.lit("text"))


def _marker(part: Column) -> Column:
    found = F.lit(OTHER)
    for kind, marker in MARKERS.items():
        found = F.when(_kind(part) == kind, F.lit(marker)).otherwise(found)
    return found


def flatten_parts(parts: Column) -> Column:
    """One string: escaped texts and placeholders in order."""
    def visit(part: Column, at: Column) -> Column:
        is_text = _kind(part) == "text"
        bare = is_text & (at == 0)
        return F.concat(F.when(bare, F.lit("")).otherwise(_marker(part)),
                        F.when(is_text, escape(part["text"])).otherwise(F.lit("")))

    return F.array_join(F.transform(parts, visit), "")


def attachments_of(parts: Column) -> Column:
    """array<struct<kind, ref, tokens>> of the parts that are not text, in order."""
    def tokens(part: Column) -> Column:
        count = F.lit(1).cast("long")
        for kind, rule in EXPANDED.items():
            count = F.when(_kind(part) == kind, rule(part).cast("long")).otherwise(count)
        return count

    return F.transform(F.filter(parts, lambda p: _kind(p) != "text"), lambda p: F.struct(
        _kind(p).alias("kind"), p["ref"].alias("ref"), tokens(p).alias("tokens")))


def format_chats(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 content: str = "text") -> DataFrame:
    """One row per conversation: its formatted text, where each turn and its loss lie, and its attachments.

    ``content`` is text or an array of ``PART``. ``turns`` has, for every turn in
    order, ``start``, ``loss_start`` and ``loss_length`` in code points of
    ``formatted`` (length 0 outside assistants' turns). ``attachments`` has, in the
    order of the placeholders, ``turn_no`` (from 0), ``kind``, ``ref``, ``tokens``.
    """
    parts = messages[content]
    if messages.schema[content].dataType.typeName() == "string":
        parts = text_part(parts)
    given = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    rows = messages.select(messages[conv].alias("conv"), messages[turn].alias("turn"),
                           F.coalesce(messages[role], F.lit("")).alias("role"), given.alias("parts"))
    rows = rows.select("conv", "turn", (F.col("role") == ASSISTANT).alias("learned"), escape(F.col("role")).alias("role"),
                       flatten_parts(F.col("parts")).alias("body"), attachments_of(F.col("parts")).alias("files"))
    rows = rows.select("conv", "turn", "role", "body", "files", "learned", F.when(F.col("learned"), F.concat("body", F.lit(END))).otherwise(
        F.concat(F.lit(OPEN), "role", F.lit(ROLE), "body", F.lit(CLOSE + END))).alias("piece"))
    order = Window.partitionBy("conv").orderBy("turn", "role", "body", F.to_json("files"))
    before = F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.select("conv", "piece", "files", F.row_number().over(order).alias("at"),
                         (F.coalesce(before, F.lit(0).cast("long")) + len(BEGIN)).alias("start"),
                         F.when(F.col("learned"), F.length("body")).otherwise(0).cast("long").alias("loss"))
    turns = placed.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("at", "start", "loss", "piece", "files"))).alias("t"))
    return turns.select(
        F.col("conv").alias(conv),
        F.concat(F.lit(BEGIN), F.array_join(F.transform("t", lambda t: t["piece"]), "")).alias("formatted"),
        F.transform("t", lambda t: F.struct(t["start"].alias("start"), t["start"].alias("loss_start"),
                                            t["loss"].alias("loss_length"))).alias("turns"),
        F.flatten(F.transform("t", lambda t: F.transform(t["files"], lambda f: F.struct(
            (t["at"] - 1).alias("turn_no"), f["kind"].alias("kind"), f["ref"].alias("ref"), f["tokens"].alias("tokens"))))
        ).alias("attachments"))


def _chunks(formatted: Column) -> Column:
    """The turns' strings without their ends, from the formatted text alone."""
    ended = F.split(F.substr(formatted, F.lit(len(BEGIN) + 1)), END)
    return F.slice(ended, F.lit(1), F.size(ended) - 1)


def _parts(body: Column) -> Column:
    """array<struct<kind, text>>; an attachment's text is null."""
    texts = F.split(body, _MARKER)
    marks = F.concat(F.array(F.lit(MARKERS["text"])), F.regexp_extract_all(body, F.lit(f"({_MARKER})"), F.lit(1)))
    kinds = F.lit("other")
    both = F.zip_with(marks, texts, lambda m, t: F.struct(m.alias("mark"), t.alias("text")))

    def named(p: Column) -> Column:
        kind = kinds
        for name, marker in MARKERS.items():
            kind = F.when(p["mark"] == marker, F.lit(name)).otherwise(kind)
        return F.struct(kind.alias("kind"), F.when(p["mark"] == MARKERS["text"], unescape(p["text"])).alias("text"))

    # what stands before the first placeholder is a part only if it is not empty, or all there is
    first = F.filter(F.slice(both, 1, 1), lambda p: (F.length(p["text"]) > 0) | (F.size(both) == 1))
    return F.transform(F.concat(first, F.slice(both, F.lit(2), F.greatest(F.size(both) - 1, F.lit(0)))), named)


def read_chats(chats: DataFrame, formatted: str = "formatted", turns: str = "turns", keep: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """What the formatted texts say: ``read`` array<struct<role, parts, text>> and ``loss`` array<string>.

    ``text`` joins a turn's text parts. ``loss`` has the unescaped text under the
    mask of every turn that has one, cut from the formatted text at the places in ``turns``.
    """
    def turn(c: Column) -> Column:
        asked = c.startswith(OPEN)
        role = F.when(asked, F.substring_index(F.substr(c, F.lit(len(OPEN) + 1)), ROLE, 1))
        start = F.when(asked, F.length(role) + len(OPEN) + len(ROLE) + 1).otherwise(1)
        size = F.when(asked, F.length(c) - F.length(role) - len(OPEN + ROLE + CLOSE)).otherwise(F.length(c))
        return F.struct(F.coalesce(unescape(role), F.lit(ASSISTANT)).alias("role"), F.substr(c, start, size).alias("body"), asked.alias("asked"))

    rows = chats.select(*[chats[c].alias(c) for c in keep], chats[formatted].alias("_formatted"), chats[turns].alias("_turns"))
    rows = rows.withColumn("_chunks", _chunks(F.col("_formatted"))).withColumn("_said", F.transform("_chunks", turn))
    masked = F.zip_with("_chunks", "_turns", lambda c, t: F.struct(
        F.substr(c, (t["loss_start"] - t["start"] + 1).cast("int"), t["loss_length"].cast("int")).alias("under"),
        t["loss_length"].alias("n")))
    said = F.transform("_said", lambda t: F.struct(t["role"].alias("role"), _parts(t["body"]).alias("parts")))
    joined = F.transform(said, lambda t: F.struct(t["role"].alias("role"), t["parts"].alias("parts"), F.array_join(
        F.transform(F.filter(t["parts"], lambda p: p["kind"] == "text"), lambda p: p["text"]), "").alias("text")))
    return rows.select(*keep, F.col("_formatted").alias("formatted"), joined.alias("read"),
                       F.transform(F.filter(masked, lambda m: m["n"] > 0), lambda m: unescape(m["under"])).alias("loss"))


def chat_digests(messages: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the output."""
    said = read_chats(format_chats(messages))
    all_turns = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return said.select(
        "conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(all_turns.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
