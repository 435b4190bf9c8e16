"""Documents in blocks of a few megabytes, and messages between blocks and shards.

Some operators ask the same small question about very many pieces of text (how
often, where first). A row per piece would cost more than the text itself. Here a
row is a block of documents, written once to the shared folder; a block asks each
distinct question once, in one packed row per shard, and gets one packed answer.
So a piece that a third of all documents hold still reaches its shard at most
once per block, and no shard or block grows with a hot key.

Blocks are numbered when they are written. Every later step reads that table, so
a repeated task sees the same blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.rows import slices
from folioflow.session import materialize

BLOCK_BYTES = 8 << 20
#: Shards are numbered, and their numbers known to all tasks.
MAX_SHARDS = 1 << 16
#: Stands for a null key: smaller than any other.
NO_KEY = -(2**63)


def squeeze(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(data)


def expand(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


class Block:
    """The documents of one row: ``keys``, where each text ends, and the texts' bytes."""

    def __init__(self, row: dict):
        import numpy as np

        self.block = row["block"]
        self.keys = row["keys"]
        self.ids = np.array([NO_KEY if k is None else k for k in self.keys], dtype=np.int64)
        self.ends = np.frombuffer(row["ends"], dtype=np.int64)
        self.starts = np.concatenate([np.zeros(1, np.int64), self.ends[:-1]]) if len(self.ends) else self.ends
        self.data = expand(row["body"])
        self.rest = row.get("rest")

    def texts(self) -> Iterator[bytes]:
        at = 0
        for end in self.ends.tolist():
            yield self.data[at:end]
            at = end


def pack(docs: DataFrame, key: str, text: str, name: str, block_bytes: int = BLOCK_BYTES, carry: bool = False) -> DataFrame:
    """(block long, keys array<long>, ends, body): written to the shared folder. Null texts become empty.

    ``carry`` adds ``rest``: per document all columns but the text, and whether that was null.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    columns = [docs[key].cast("long").alias("key"), docs[text].alias("text")]
    schema = "block long, keys array<long>, ends binary, body binary"
    if carry:
        others = [F.col(f"`{c}`") for c in docs.columns if c != text]
        columns.append(F.struct(F.struct(*others).alias("row"), docs[text].isNull().alias("no_text")).alias("rest"))
    source = docs.select(*columns)
    rest_type = None
    if carry:
        rest_type = to_arrow_type(source.schema["rest"].dataType)
        schema += f", rest array<{source.schema['rest'].dataType.simpleString()}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", block_bytes):
                column = pc.fill_null(part.column("text"), "").cast(pa.large_binary())
                ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
                data = memoryview(column.buffers()[2] or b"")[ends[0]:ends[-1]]
                out = [pa.array([number]), pa.array([part.column("key").to_pylist()], pa.list_(pa.int64())),
                       pa.array([(ends[1:] - ends[0]).tobytes()], pa.binary()), pa.array([squeeze(bytes(data))], pa.binary())]
                if carry:
                    out.append(pa.array([part.column("rest").to_pylist()], pa.list_(rest_type)))
                yield pa.RecordBatch.from_arrays(out, ["block", "keys", "ends", "body", "rest"][:len(out)])
                number += 1

    return materialize(source.mapInArrow(run, schema), name)


def per_row(df: DataFrame, rows_of: Callable[[dict], Iterator[dict]], schema: str) -> DataFrame:
    """Each row, as a dict, becomes any number of rows."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_struct(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                got = list(rows_of(batch.slice(i, 1).to_pylist()[0]))
                if got:
                    yield pa.RecordBatch.from_pylist(got, arrow)

    return df.mapInArrow(run, schema)


def per_shard(df: DataFrame, rows_of: Callable[[list[dict]], Iterator[dict]], schema: str, by: str = "shard") -> DataFrame:
    """All rows of a shard, as dicts ordered by block, become any number of rows."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_struct(schema))

    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(list(rows_of(table.to_pylist())), arrow)

    return df.groupBy(by).applyInArrow(run, schema)


def together(left: DataFrame, right: DataFrame, by: str,
             rows_of: Callable[[list[dict], list[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """The rows of both frames with one value of ``by`` become any number of rows."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_struct(schema))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(list(rows_of(a.to_pylist(), b.to_pylist())), arrow)

    return left.groupBy(by).cogroup(right.groupBy(by)).applyInArrow(run, schema)


def _struct(schema):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema) if isinstance(schema, str) else schema


def shards_for(total: int, each: int) -> int:
    """Shards of about ``each`` entries."""
    return max(1, min(MAX_SHARDS, -(-total // each)))


def sum_of(df: DataFrame, column: str) -> int:
    return df.agg(F.coalesce(F.sum(column), F.lit(0))).first()[0]
