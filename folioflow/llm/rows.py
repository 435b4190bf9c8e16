"""Arrow batches inside tasks: small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Rows of an Arrow batch are handed on in slices of about this many bytes of text.
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that ``column`` holds at most ``limit`` bytes, or one row."""
    start, size = 0, 0
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    for i, n in enumerate(lengths):
        if i > start and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def per_text(df: DataFrame, key: str, text: str, one: Callable[[], Callable[[str], tuple]],
             names: list[str], types: list[pa.DataType], schema: str) -> DataFrame:
    """One output row per input row: the key and what ``one()`` makes of the text.

    ``one`` is called once per task and returns the function for a text; a null
    text counts as empty. Only the two columns reach Python, whatever else the
    frame holds.
    """
    source = df.select(df[key].alias("_key"), df[text].alias("_text"))
    key_type = dict(source.dtypes)["_key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = one()
        for batch in batches:
            for part in slices(batch, "_text"):
                got = [fn(t or "") for t in part.column("_text").to_pylist()]
                columns = zip(*got) if got else [[] for _ in names]
                arrays = [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("_key"), *arrays], ["_key", *names])

    return source.mapInArrow(run, f"_key {key_type}, {schema}").withColumnRenamed("_key", key)
