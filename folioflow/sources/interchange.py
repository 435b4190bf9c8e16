"""Interchange segments as a Spark data source, written in two phases.

``df.write.format("interchange").mode("append").save(folder)`` and
``spark.read.format("interchange").load(folder)`` after ``register(spark)``. Rows are
segments (``SCHEMA``); a file holds one JSON object per line. Tasks write files of
their own names; a file counts once a commit lists it, and a commit is one small file
that appears whole. So a failed or repeated task, or a job that ends before its
commit, leaves nothing that a reader sees. Overwriting commits the new list, which
names the commits that it takes the place of.

The folder has to be one that driver and executors share; it is reached through
``pyarrow.fs``, so it may be a path or an address such as hdfs:// or s3://.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from folioflow.session import BATCH_BYTES

if TYPE_CHECKING:
    from pyarrow import RecordBatch

SCHEMA = "doc_id string, segment_id string, page int, source string, translated string"
FIELDS = [part.split()[0] for part in SCHEMA.split(", ")]
#: Rows and bytes of one file; a task with more writes several.
FILE_ROWS = 200_000
FILE_BYTES = 64 << 20


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _list(path: str) -> list[str]:
    from pyarrow import fs

    system, folder = _open(path)
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.base_name for f in found if f.is_file)


def _text(path: str, name: str) -> str:
    system, folder = _open(path)
    with system.open_input_stream(f"{folder}/{name}") as held:
        return held.read().decode()


def _commits(path: str) -> dict[str, list[str]]:
    """Files of every commit that no later one replaces."""
    found = {n: json.loads(_text(path, n)) for n in _list(path) if n.startswith("commit-") and n.endswith(".json")}
    gone = {r for c in found.values() for r in c["replaces"]}
    return {n: c["files"] for n, c in found.items() if n not in gone}


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        system, folder = _open(self.path)
        system.create_dir(folder, recursive=True)
        names: list[str] = []
        out, rows, size = None, 0, 0
        try:
            for row in iterator:  # lines leave as they come, so a task holds one of them
                if out is None:
                    names.append(f"part-{self.job}-{uuid.uuid4().hex}.jsonl")
                    out = io.BufferedWriter(system.open_output_stream(f"{folder}/{names[-1]}"), 1 << 20)
                    rows = size = 0
                size += out.write(json.dumps({f: row[f] for f in FIELDS}, ensure_ascii=False).encode() + b"\n")
                rows += 1
                if rows >= FILE_ROWS or size >= FILE_BYTES:
                    out.close()
                    out = None
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = _open(self.path)
        system.create_dir(folder, recursive=True)
        told = {"files": [f for m in messages if m for f in m.files],
                "replaces": sorted(_commits(self.path)) if self.overwrite else []}
        name = f"commit-{self.job}.json"
        with system.open_output_stream(f"{folder}/{name}.draft") as out:
            out.write(json.dumps(told).encode())
        system.move(f"{folder}/{name}.draft", f"{folder}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = _open(self.path)
        for name in _list(self.path):  # also what failed tasks left
            if name.startswith(f"part-{self.job}-"):
                system.delete_file(f"{folder}/{name}")


class OneFile(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


def _batch(lines: list[bytes]) -> RecordBatch:
    import pyarrow as pa

    got = [json.loads(line) for line in lines]
    kinds = [pa.int32() if f == "page" else pa.string() for f in FIELDS]
    return pa.RecordBatch.from_arrays([pa.array([g.get(f) for g in got], k) for f, k in zip(FIELDS, kinds)], FIELDS)


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[OneFile]:
        return [OneFile(n) for files in _commits(self.path).values() for n in files]

    def read(self, partition: OneFile | None) -> Iterator[RecordBatch]:
        """Batches of bounded size: a file is read line by line."""
        if partition is None:  # nothing was committed
            return
        system, folder = _open(self.path)
        lines, size = [], 0
        with system.open_input_stream(f"{folder}/{partition.name}") as held:
            for line in io.BufferedReader(held, 1 << 20):
                if line != b"\n":
                    lines.append(line)
                    size += len(line)
                if size >= BATCH_BYTES:
                    yield _batch(lines)
                    lines, size = [], 0
        if lines:
            yield _batch(lines)


class Interchange(DataSource):
    @classmethod
    def name(cls) -> str:
        return "interchange"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        lacking = set(FIELDS) - set(schema.names)
        if lacking:
            raise ValueError(f"interchange rows need {', '.join(sorted(lacking))}")
        return Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Interchange)
