"""SentencePiece BPE encoding and decoding through a prefix table.

Every prefix of a text has exactly one encoding, so it is enough to store its
last token: the one token that ends there, by the automaton's matches, and that
the last token of the remaining shorter prefix tolerates to its left. Two tokens
tolerate each other when encoding their joined text by merging gives just them.
The ids come out by walking the table backwards. Time is linear in the text.

Defined results: a null or empty text has no ids and decodes to an empty text;
characters outside the vocabulary become byte pieces; the space mark itself in
a text decodes to a space, as the library does it. Texts of any length are
encoded whole. Repeated rows and keys are kept as they are, an empty table gives
an empty table, and columns besides the two named ones never matter.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from folioflow.llm.rows import per_text

SPACE = "▁"
MODEL = "piece_bpe_32k.model"
#: Chunks whose ids, and pairs whose test, a worker remembers; beyond it the memory starts afresh.
REMEMBERED = 300_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


class PieceTable:
    """A merge-type vocabulary: its automaton, the pair tests, encode and decode."""

    def __init__(self, model: bytes):
        import ahocorasick
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = lib.get_piece_size()
        self.texts = [lib.id_to_piece(i) for i in range(size)]
        self.bytes_of = {}
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        for i, piece in enumerate(self.texts):
            if lib.is_byte(i):
                self.bytes_of[i] = int(piece[3:5], 16)
            elif not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)):
                self.scores[piece] = lib.get_score(i)
                self.ids[piece] = i
        self.byte_ids = {b: i for i, b in self.bytes_of.items()}
        self.unknown = lib.unk_id()
        self.pairs: dict[int, bool] = {}  # by left id * vocabulary + right id
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if self.merge(piece) == [piece]:  # else no encoding holds it
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        inner = re.compile(f"[^{SPACE}]{SPACE}")
        whole = any(inner.search(piece) for piece in self.ids)
        self.whole = whole  # pieces reach over spaces: no cutting there
        self.chunks = (lambda t: [t]) if whole else re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall

    def merge(self, text: str) -> list[str]:
        """Encoding by its definition: best score first, then leftmost. For short texts."""
        parts: list[str | None] = list(text)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str, str]] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else len(parts)
            if j < len(parts):
                score = self.scores.get(parts[i] + parts[j])
                if score is not None:
                    heapq.heappush(heap, (-score, i, parts[i], parts[j]))

        for i in range(len(parts)):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            if parts[i] != a or (j := after[i]) >= len(parts) or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(i)
            offer(before[i])
        return [p for p in parts if p is not None]

    def compatible(self, a: int, b: int) -> bool:
        known = self.pairs.get(a * len(self.texts) + b)
        if known is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            left, right = self.texts[a], self.texts[b]
            known = self.pairs[a * len(self.texts) + b] = self.merge(left + right) == [left, right]
        return known

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of a chunk that no piece reaches beyond."""
        ends: list[int] = [-1] * (len(chunk) + 1)  # the prefix's last token, -1: a character without piece
        sizes: list[int] = [1] * (len(chunk) + 1)
        pairs, done, count = self.pairs, 0, len(self.texts)
        for end, (token, size) in self.automaton.iter(chunk):  # longest first at each end
            end += 1
            if end == done:
                continue
            start = end - size
            last = ends[start]
            if start and last >= 0:
                ok = pairs.get(last * count + token)
                if ok is None:
                    ok = self.compatible(last, token)
                if not ok:
                    continue
            ends[end], sizes[end], done = token, size, end
        out: list[int] = []
        at = len(chunk)
        while at:
            if ends[at] >= 0:
                out.append(ends[at])
            else:
                data = chunk[at - 1].encode("utf-8")
                out.extend(self.byte_ids.get(b, self.unknown) for b in reversed(data))
            at -= sizes[at]
        out.reverse()
        return out

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        marked = SPACE + text.replace(" ", SPACE)
        return [i for chunk in self.chunks(marked) for i in self.encode_chunk(chunk)]

    def decode(self, ids: list[int], first: bool = True) -> str:
        """Text of the ids; ``first``: they stand at the start of a text."""
        out, raw = [], bytearray()

        def flush() -> None:
            while raw:
                try:
                    out.append(raw.decode("utf-8"))
                    raw.clear()
                except UnicodeDecodeError as e:
                    out.append(raw[: e.start].decode("utf-8") + "�")
                    del raw[: e.start + 1]

        for n, i in enumerate(ids):
            if i in self.bytes_of:
                raw.append(self.bytes_of[i])
                continue
            flush()
            piece = self.texts[i]
            if first and n == 0:
                piece = piece.removeprefix(SPACE)
            if piece in self.ids or n == 0 and SPACE + piece in self.ids:
                out.append(piece.replace(SPACE, " "))
        flush()
        return "".join(out)


_TABLES: dict[str, PieceTable] = {}


def table_for(model: bytes) -> PieceTable:
    """The table of a model; one per Python worker."""
    name = hashlib.sha256(model).hexdigest()
    if name not in _TABLES:
        _TABLES[name] = PieceTable(model)
    return _TABLES[name]


def read_model(spark, path: str | None) -> bytes:
    """The model file's bytes, read where the driver runs and shipped to the tasks."""
    path = os.fspath(path or default_model())
    with open(path, "rb") as file:
        return file.read()


def _digests(model, with_ids: bool = False) -> Callable[[str], tuple]:
    """For a text: number of ids, digest of the ids, digest of the decoded text, and on demand the ids."""
    import numpy as np

    pieces = table_for(model.value)
    cut = (lambda t: [t]) if pieces.whole else re.compile(" *[^ ]+| +").findall
    known: dict[str, str] = {}  # ids as they are joined
    odd: dict[str, str] = {}  # what a chunk decodes to, where that is not the chunk itself
    long: list[str] = []  # chunks of the last text that are not worth remembering

    def ids_of(chunk: str) -> str:
        ids = pieces.encode_chunk(chunk.replace(" ", SPACE))
        told = ",".join(map(str, ids))
        back = pieces.decode(ids, first=False)
        if back != chunk:
            odd[chunk] = back
        if len(chunk) <= 64:
            known[chunk] = told
        else:
            long.append(chunk)
        return told

    def one(text: str) -> tuple:
        for chunk in long:
            odd.pop(chunk, None)
        long.clear()
        if len(known) >= REMEMBERED:  # between texts, since a text needs what it has met
            known.clear()
            odd.clear()
        if not text:
            ids, decoded = "", ""
        else:
            plain = " " + text.replace(SPACE, " ")  # the mark and the space are one
            chunks = cut(plain)
            look = known.get
            ids = ",".join([look(c) or ids_of(c) for c in chunks])
            if odd and not odd.keys().isdisjoint(chunks):
                plain = "".join([odd.get(c, c) for c in chunks])
            decoded = plain.removeprefix(" ")
        out = (ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(),
               hashlib.sha256(decoded.encode()).hexdigest())
        return (*out, np.array(ids.split(",") if ids else [], dtype=np.int32)) if with_ids else out

    return one


def piece_digests(df: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every row; no shuffle."""
    shipped = df.sparkSession.sparkContext.broadcast(read_model(df.sparkSession, model))  # a file of fixed size
    return per_text(df, key, text, lambda: _digests(shipped), ["n_tokens", "ids_sha256", "decoded_sha256"],
                    [pa.int64(), pa.string(), pa.string()], "n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_pieces(df: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """The same with the ids themselves: (key, n_tokens, ids_sha256, decoded_sha256, ids array<int>)."""
    shipped = df.sparkSession.sparkContext.broadcast(read_model(df.sparkSession, model))
    return per_text(
        df, key, text, lambda: _digests(shipped, with_ids=True), ["n_tokens", "ids_sha256", "decoded_sha256", "ids"],
        [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())],
        "n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>")


def decode_pieces(df: DataFrame, key: str = "doc_id", ids: str = "ids", model: str | None = None) -> DataFrame:
    """(key, decoded string) from arrays of ids; a null array decodes to an empty text."""
    shipped = df.sparkSession.sparkContext.broadcast(read_model(df.sparkSession, model))
    source = df.select(df[key].alias("_key"), df[ids].alias("_ids"))

    def run(batches):
        pieces = table_for(shipped.value)
        for batch in batches:
            texts = [pieces.decode(i or []) for i in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(texts, pa.string())], ["_key", "decoded"])

    kind = dict(source.dtypes)["_key"]
    return source.mapInArrow(run, f"_key {kind}, decoded string").withColumnRenamed("_key", key)
