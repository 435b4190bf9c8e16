"""Greedy packing of ordered rows into batches with character and row limits.

A batch is cut before a row when the row would exceed the limits or changes
kind. Where the next batch starts depends only on where the current one starts,
so the cuts form a chain of jumps of at most ``max_rows`` rows. That makes two
exact forms possible:

* ``starts_in_row`` for groups that are one input row (a document's lines): one
  pass over its arrays inside the row, no shuffle at all;
* ``assign_batches`` for groups of any size: each block of rows is reduced to
  a table "entered at offset e, left at offset e', batches opened", the tables
  are composed block by block, and the blocks are expanded again. No task ever
  holds more than one block of rows or one block of tables.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow import constants as K
from folioflow.functions.arrow import arrow_batched
from folioflow.functions.binding import let
from folioflow.operators import blocked
from folioflow.session import materialize

LEAF_ROWS = 8192
FAN = 8192


def next_starts(sizes: np.ndarray, kinds: np.ndarray, max_size: int, max_rows: int) -> np.ndarray:
    """For every row: the start of the following batch if a batch starts here."""
    n = len(sizes)
    total = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    rows = np.arange(n)
    by_size = np.searchsorted(total, total[:-1] + max_size, side="right") - 1
    changes = np.flatnonzero(kinds[1:] != kinds[:-1]) + 1
    after = np.searchsorted(changes, rows, side="right")
    by_kind = np.append(changes, n)[after]
    ends = np.minimum(np.minimum(by_size, rows + max_rows), by_kind)
    return np.maximum(ends, rows + 1)


def batch_starts(sizes: np.ndarray, kinds: np.ndarray, max_size: int, max_rows: int) -> list[int]:
    """1-based first rows of the batches of one whole list."""
    if not len(sizes):
        return []
    jump = next_starts(sizes, kinds, max_size, max_rows).tolist()
    out, at = [], 0
    while at < len(jump):
        out.append(at + 1)
        at = jump[at]
    return out


def starts_in_row(max_size: int = K.BATCH_CHARS, max_rows: int = K.BATCH_SEGMENTS):
    """Column function (sizes ARRAY<INT>, kinds ARRAY<BOOLEAN>) -> 1-based batch starts."""

    def step(so_far: Column, row: Column) -> Column:
        full = (so_far["rows"] == 0) | (so_far["rows"] >= max_rows) | (so_far["size"] + row["size"] > max_size)
        cut = full | (so_far["kind"] != row["kind"])
        return let(cut, lambda opens: F.struct(
            (F.when(opens, F.lit(0)).otherwise(so_far["size"]) + row["size"]).alias("size"),
            (F.when(opens, F.lit(0)).otherwise(so_far["rows"]) + 1).alias("rows"), row["kind"].alias("kind"),
            (so_far["seen"] + 1).alias("seen"),
            F.when(opens, F.concat(so_far["starts"], F.array(so_far["seen"] + 1))).otherwise(so_far["starts"]).alias("starts")))

    def starts(sizes: Column, kinds: Column) -> Column:
        rows = F.zip_with(sizes, kinds, lambda s, k: F.struct(s.cast("bigint").alias("size"), k.alias("kind")))
        none = F.struct(F.lit(0).cast("bigint").alias("size"), F.lit(0).alias("rows"), F.lit(False).alias("kind"),
                        F.lit(0).alias("seen"), F.array().cast("array<int>").alias("starts"))
        return F.aggregate(rows, none, step, lambda done: done["starts"])

    return starts


def slices(items: Column, starts: Column) -> Column:
    """Cut an array into the runs that begin at the given 1-based starts."""
    after = F.size(items) + 1
    return F.transform(
        starts,
        lambda at, i: F.slice(
            items, at, F.coalesce(F.try_element_at(starts, i + 2), after) - at
        ),
    )


def _leaf_tables(max_size: int, max_rows: int):
    @arrow_batched("struct<exits:array<int>, counts:array<bigint>>")
    def tables(sizes: pd.Series, kinds: pd.Series, own: pd.Series) -> pd.DataFrame:
        out = []
        for s, k, n in zip(sizes, kinds, own):
            jump = next_starts(np.asarray(s), np.asarray(k, dtype=bool), max_size, max_rows).tolist()
            leave, opened = [0] * n, [0] * n
            for row in range(n - 1, -1, -1):
                to = jump[row]
                if to >= n:
                    leave[row], opened[row] = to - n, 1
                else:
                    leave[row], opened[row] = leave[to], opened[to] + 1
            # a short last block can be jumped over; nothing follows it
            entries = range(max_rows)
            out.append((
                [leave[e] if e < n else e - n for e in entries],
                [opened[e] if e < n else 0 for e in entries],
            ))
        return pd.DataFrame(out, columns=["exits", "counts"])

    return tables


@arrow_batched("struct<exits:array<int>, counts:array<bigint>>")
def _compose(exits: pd.Series, counts: pd.Series) -> pd.DataFrame:
    """Compose the tables of consecutive blocks into one."""
    out = []
    for ex, cn in zip(exits, counts):
        state = np.arange(len(ex[0]))
        opened = np.zeros(len(state), dtype=np.int64)
        for leave, number in zip(ex, cn):
            opened = opened + np.asarray(number)[state]
            state = np.asarray(leave)[state]
        out.append((state, opened))
    return pd.DataFrame(out, columns=["exits", "counts"])


@arrow_batched("array<struct<entry:int, base:bigint>>")
def _entries(entry: pd.Series, base: pd.Series, exits: pd.Series, counts: pd.Series) -> pd.Series:
    """Entry offset and batches opened before, for every child of a block."""
    out = []
    for state, opened, ex, cn in zip(entry, base, exits, counts):
        children = []
        for leave, number in zip(ex, cn):
            children.append({"entry": int(state), "base": int(opened)})
            state, opened = leave[state], opened + number[state]
        out.append(children)
    return pd.Series(out)


def _expand(max_size: int, max_rows: int):
    @arrow_batched("array<bigint>")
    def numbers(sizes: pd.Series, kinds: pd.Series, own: pd.Series, entry: pd.Series,
                base: pd.Series) -> pd.Series:
        out = []
        for s, k, n, e, b in zip(sizes, kinds, own, entry, base):
            jump = next_starts(np.asarray(s), np.asarray(k, dtype=bool), max_size, max_rows).tolist()
            got = np.empty(n, dtype=np.int64)
            got[:e] = b - 1  # rows of the batch opened in the block before
            at, number = e, b
            while at < n:
                got[at:jump[at]] = number
                at, number = jump[at], number + 1
            out.append(got)
        return pd.Series(out)

    return numbers


def _stack(tables: DataFrame, keys: Sequence[str], child: str, parent: Column) -> DataFrame:
    """Gather the tables of consecutive children under their parent (bounded by FAN)."""
    return (
        tables.withColumn("_parent", parent)
        .groupBy(*keys, "_parent")
        .agg(F.array_sort(F.collect_list(F.struct(child, "exits", "counts"))).alias("_stack"))
        .select(
            *keys, "_parent",
            F.col(f"_stack.{child}").alias("_children"),
            F.col("_stack.exits").alias("_exits"),
            F.col("_stack.counts").alias("_counts"),
        )
    )


def _hand_down(stacks: DataFrame, keys: Sequence[str], child: str) -> DataFrame:
    return (
        stacks.withColumn("_in", _entries("entry", "base", "_exits", "_counts"))
        .select(*keys, F.explode(F.arrays_zip("_children", "_in")).alias("_z"))
        .select(*keys, F.col("_z._children").alias(child),
                F.col("_z._in.entry").alias("entry"), F.col("_z._in.base").alias("base"))
    )


def assign_batches(rows: DataFrame, keys: Sequence[str], order: Sequence[str], size: Column,
                   kind: Column, max_size: int = K.BATCH_CHARS, max_rows: int = K.BATCH_SEGMENTS,
                   leaf_rows: int = LEAF_ROWS, fan: int = FAN) -> DataFrame:
    """Batch number of every row: keys, order columns, ``idx`` and ``batch_id``.

    ``rows`` carries block numbers (``blocked.with_block``) that rise with
    ``order``. Keys, order, sizes and kinds are written out once, as several
    steps read them; only they are shuffled. Join the result back to the wide
    rows on keys and order.
    """
    if max_rows > leaf_rows:
        raise ValueError("a batch must fit into one block of rows")
    keys, order = list(keys), list(order)
    narrow = materialize(
        rows.select(*keys, *order, blocked.BLOCK, size.cast("bigint").alias("_size"),
                    kind.alias("_kind")),
        "sizes",
    )
    indexed = blocked.row_number(narrow, keys, order, "idx").withColumn("idx", F.col("idx") - 1)
    leaf = F.floor(F.col("idx") / leaf_rows)
    offset = F.col("idx") % leaf_rows
    # the first rows of a block are also seen by the block before, as look-ahead
    homes = F.when(
        (leaf > 0) & (offset < max_rows), F.array(leaf, leaf - 1)
    ).otherwise(F.array(leaf))
    own_leaf = F.floor(F.col("_r.idx") / leaf_rows) == F.col("_leaf")
    leaves = (
        indexed.withColumn("_leaf", F.explode(homes))
        .groupBy(*keys, "_leaf")
        .agg(
            F.array_sort(F.collect_list(F.struct("idx", *order, "_size", "_kind"))).alias("_rows"),
            F.count_if(leaf == F.col("_leaf")).cast("int").alias("_own"),
        )
        .withColumn("_sizes", F.col("_rows._size"))
        .withColumn("_kinds", F.col("_rows._kind"))
    )
    tables = leaves.select(
        *keys, "_leaf", _leaf_tables(max_size, max_rows)("_sizes", "_kinds", "_own").alias("_t")
    ).select(*keys, "_leaf", "_t.*")
    supers = _stack(tables, keys, "_leaf", F.floor(F.col("_leaf") / fan))
    super_tables = supers.select(
        *keys, F.col("_parent").alias("_super"), _compose("_exits", "_counts").alias("_t")
    ).select(*keys, "_super", "_t.*")
    top = (
        _stack(super_tables, keys, "_super", F.lit(0))
        .withColumn("entry", F.lit(0)).withColumn("base", F.lit(0).cast("bigint"))
    )
    super_entries = _hand_down(top, keys, "_super")
    leaf_entries = _hand_down(
        supers.withColumnRenamed("_parent", "_super").join(super_entries, [*keys, "_super"]),
        keys, "_leaf",
    )
    numbered = leaves.join(leaf_entries, [*keys, "_leaf"]).withColumn(
        "_numbers", _expand(max_size, max_rows)("_sizes", "_kinds", "_own", "entry", "base")
    )
    return (
        numbered.select(*keys, "_leaf", F.explode(F.arrays_zip("_rows", "_numbers")).alias("_z"))
        .select(*keys, "_leaf", F.col("_z._rows").alias("_r"), F.col("_z._numbers").alias("batch_id"))
        .where(own_leaf)
        .select(*keys, *[F.col(f"_r.{o}").alias(o) for o in order], F.col("_r.idx").alias("idx"),
                "batch_id")
    )


def batch_summary(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fill of every batch: rows, characters, first and last position."""
    return rows.groupBy(*keys, "batch_id").agg(
        F.count("*").alias("segments"),
        F.sum(F.length("text")).alias("chars"),
        F.min("pos").alias("first_pos"),
        F.max("pos").alias("last_pos"),
    )


def word_chunks(texts: DataFrame, key: str, text: Column, page: Column,
                max_tokens: int = K.CHUNK_TOKENS) -> DataFrame:
    """Split each text into chunks of whole words with a token budget.

    One text is one row, so the cuts are made inside the row.
    """
    from folioflow.functions.text import word_cost, words

    cut = starts_in_row(max_tokens, 1 << 30)
    split = texts.select(key, page.alias("page"), words(text).alias("_words"))
    starts = cut(F.transform("_words", word_cost), F.transform("_words", lambda w: F.lit(False)))
    chunks = F.transform(
        slices(F.col("_words"), F.col("_starts")), lambda run: F.array_join(run, " ")
    )
    return (
        split.withColumn("_starts", starts)
        .select(key, "page", F.posexplode(chunks).alias("n", "chunk"))
        .select(
            key, "page",
            F.concat(F.lit("p"), F.col("page"), F.lit("_c"), F.col("n")).alias("chunk_id"),
            "chunk",
        )
    )
