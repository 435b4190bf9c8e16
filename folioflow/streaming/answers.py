"""Answers from token streams, kept as state per request while tokens arrive."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioflow.session import state_on_disk

#: Requests are kept together by a hash of their key: a call of the state function costs more than a request's tokens.
BUCKETS = 2048
#: Number of tokens and bytes of what follows, before it was compressed.
_HEAD = struct.Struct("<qq")


@dataclass
class _Request:
    """What is kept of a request beside its tokens: the position of its end mark (-1: not seen), answered or not, and
    until when (milliseconds) it waits."""

    end: int = -1
    done: bool = False
    until: int = 0


@dataclass
class _Tokens:
    """Tokens of many requests as columns: number of the request, position and text.

    A bucket holds the open tokens of all its requests, which are many more than those of a request,
    so there is never an object per token.
    """

    owner: np.ndarray
    pos: np.ndarray
    token: pa.Array

    def where(self, chosen: np.ndarray) -> _Tokens:
        return _Tokens(self.owner[chosen], self.pos[chosen], self.token.filter(pa.array(chosen)))


def _layout(tokens: pa.Array) -> tuple[np.ndarray, bytes | pa.Buffer]:
    """Offsets of the strings of an array, and the bytes they point into."""
    _, offsets, text = tokens.buffers()
    if not len(tokens):
        return np.zeros(1, np.int32), b""
    return np.frombuffer(offsets, np.int32)[tokens.offset:tokens.offset + len(tokens) + 1], text or b""


def _strings(sizes: np.ndarray, text: bytes) -> pa.Array:
    """The strings of such sizes that follow each other in ``text``."""
    offsets = np.append(np.int32(0), np.cumsum(sizes, dtype=np.int32))
    return pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(text)])


def _planes(numbers: np.ndarray) -> bytes:
    """The lowest bytes of all numbers, then the next ones and so on: of small numbers most planes are empty."""
    return np.ascontiguousarray(numbers, "<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def _pack(held: _Tokens) -> bytes:
    offsets, text = _layout(held.token)
    raw = b"".join((
        _planes(np.diff(held.owner, prepend=np.int32(0))), _planes(np.diff(held.pos, prepend=np.int32(0))),
        _planes(np.diff(offsets)), memoryview(text)[offsets[0]:offsets[-1]]))
    return _HEAD.pack(len(held.owner), len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(packed: bytes) -> _Tokens:
    n, size = _HEAD.unpack_from(packed)
    raw = pa.decompress(memoryview(packed)[_HEAD.size:], size, codec="zstd", asbytes=True)
    owner, pos, sizes = (_numbers(raw[4 * n * i:4 * n * (i + 1)]) for i in range(3))
    return _Tokens(np.cumsum(owner, dtype=np.int32), np.cumsum(pos, dtype=np.int32), _strings(sizes, raw[12 * n:]))


def _merge(held: _Tokens | None, new: list[tuple[int, bytes, bytes, bytes]]) -> _Tokens:
    """Tokens by request and position; of those that come again the first stays. ``new``: request, positions, sizes, texts."""
    owner = np.repeat(np.array([n for n, *_ in new], np.int32), [len(p) // 4 for _, p, *_ in new])
    pos, sizes = (np.frombuffer(b"".join(row[i] for row in new), "<i4") for i in (1, 2))
    token = _strings(sizes, b"".join(row[3] for row in new))
    if held is not None:
        owner, pos = np.concatenate((held.owner, owner)), np.concatenate((held.pos, pos))
        token = pa.concat_arrays([held.token, token])
    place = (owner.astype(np.int64) << 32) + pos
    order = np.argsort(place, kind="stable")
    order = order[np.diff(place[order], prepend=np.int64(-1 << 62)) != 0]
    return _Tokens(owner[order], pos[order], token.take(pa.array(order)))


def _joined(tokens: _Tokens, sep: str) -> list[str]:
    """One text per request that has tokens, in the order of their numbers."""
    starts = np.flatnonzero(np.diff(tokens.owner, prepend=np.int32(-1)))
    bounds = np.append(starts, len(tokens.owner)).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), tokens.token), sep).to_pylist()


def _gather(tokens: DataFrame, key: str) -> DataFrame:
    """Tokens of a request that arrive side by side become one row: key, pos, size, token, end, newest (microseconds).

    Positions, sizes in bytes and texts are packed side by side. What meets in one Arrow batch is gathered,
    in its order, so that state is looked up and written per handful of rows and not per token.
    """
    kind = tokens.schema[key].dataType.simpleString()
    rows = tokens.select(
        key, F.col("pos").cast("int").alias("pos"), "token",
        F.when(F.col("last"), F.col("pos").cast("int")).otherwise(-1).alias("end"), F.unix_micros("at").alias("newest"))

    def binary(ends: np.ndarray, data) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])

    def gather(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.column("pos").null_count or part.column("token").null_count:
                raise ValueError("a token without position or text")
            met = pa.Table.from_batches([part]).group_by(key, use_threads=False).aggregate(
                [("pos", "list"), ("token", "list"), ("end", "max"), ("newest", "max")]).combine_chunks()
            for made in met.to_batches():
                ends, token = np.asarray(made.column("pos_list").offsets), made.column("token_list").values
                offsets, text = _layout(token)
                yield pa.RecordBatch.from_arrays(
                    [made.column(key), binary(4 * ends, np.asarray(made.column("pos_list").values).astype("<i4")),
                     binary(4 * ends, np.diff(offsets).astype("<i4")), binary(offsets[ends], text),
                     made.column("end_max"), made.column("newest_max")],
                    [key, "pos", "size", "token", "end", "newest"])

    return rows.mapInArrow(gather, f"{key} {kind}, pos binary, size binary, token binary, end int, newest bigint")


def live_answers(tokens: DataFrame, sep: str = " ", delay: str = "1 hour", idle_seconds: int = 3600, key: str = "request_id",
                 buckets: int = BUCKETS) -> DataFrame:
    """(key, text, complete): one row per request, once its end mark and all tokens before it are there.

    ``tokens`` is a stream of key, pos (from 0), token, last (the end mark) and at (a
    timestamp). Tokens may come in any order and more than once, over any number of
    micro-batches and restarts; what comes again for an answered request is dropped.
    A request without new tokens for ``idle_seconds`` of event time ends with what it
    has, as not complete, and is forgotten, as an answered one is. A token that is later
    than ``delay`` counts if it comes beside one of its request that is not.
    A checkpoint belongs to its number of ``buckets``. State lies on the executors' disks
    (``state_on_disk``), the open tokens of a bucket as compressed columns.
    """
    state_on_disk(tokens.sparkSession)
    kind = tokens.schema[key].dataType.simpleString()

    def collect(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        *columns, packed = state.get if state.exists else ([], [], [], [], None)
        kept = {name: _Request(*row) for name, *row in zip(*columns)}
        numbers = {name: n for n, name in enumerate(kept)}
        new: list[tuple[int, bytes, bytes, bytes]] = []  # of the open requests
        for part in () if state.hasTimedOut else parts:
            names = [None if pd.isna(name) else name for name in part[key].tolist()]
            for name, pos, size, token, end, newest in zip(
                    names, part["pos"], part["size"], part["token"], part["end"].tolist(), part["newest"].tolist()):
                request = kept.setdefault(name, _Request())
                number = numbers.setdefault(name, len(numbers))
                request.until = max(request.until, max(now, newest // 1000) + idle_seconds * 1000)
                if request.done:
                    continue
                request.end = max(request.end, end)
                new.append((number, pos, size, token))
        held = _merge(None if packed is None else _unpack(packed), new)
        counts = np.bincount(held.owner, minlength=len(kept)).tolist()
        answered = [0 <= r.end < n and not r.done for r, n in zip(kept.values(), counts)]
        over = [r.until < now for r in kept.values()]
        out = [(name, full) for (name, r), full, late in zip(kept.items(), answered, over) if full or late and not r.done]
        if out:
            leaves = np.array([full or late for full, late in zip(answered, over)])[held.owner]
            texts = _joined(held.where(leaves), sep)
            held = held.where(~leaves)
        for r, full in zip(kept.values(), answered):
            r.done |= full
        stay = ~np.array(over, bool)
        kept = {name: r for (name, r), late in zip(kept.items(), over) if not late}
        if kept:
            held.owner = (np.cumsum(stay) - 1).astype(np.int32)[held.owner]
            state.update((*map(list, zip(*((name, *astuple(r)) for name, r in kept.items()))), _pack(held)))
            state.setTimeoutTimestamp(max(min(r.until for r in kept.values()), now + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame([(name, text, full) for (name, full), text in zip(out, texts, strict=True)],
                               columns=[key, "text", "complete"])

    bucket = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets))).cast("int")
    gathered = _gather(tokens, key).withColumn("at", F.timestamp_micros("newest")).withWatermark("at", delay)
    return gathered.withColumn("_bucket", bucket).groupBy("_bucket").applyInPandasWithState(
        collect, f"{key} {kind}, text string, complete boolean",
        f"key array<{kind}>, end array<int>, done array<boolean>, until array<bigint>, held binary",
        "append", GroupStateTimeout.EventTimeTimeout)
