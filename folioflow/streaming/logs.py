"""Growing log files as a stream of lines.

``spark.readStream.format("log_tail").load(folder)`` after ``register(spark)``. The
offset is the number of bytes read of every file, so each line that is ended by a line
feed comes once, in the first trigger after it was finished, also across restarts. A
file that became shorter was started anew and is read from its beginning.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "file string, offset long, line string"
#: Bytes of a file that one task reads.
PIECE_BYTES = 32 << 20
_STEP = 1 << 16


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _line_end(held, at: int) -> int:
    """The place behind the last line feed before ``at``; 0 without any."""
    while at > 0:
        start = max(0, at - _STEP)
        found = held.read_at(at - start, start).rfind(b"\n")
        if found >= 0:
            return start + found + 1
        at = start
    return 0


class Piece(InputPartition):
    def __init__(self, file: str, start: int, end: int):
        super().__init__((file, start, end))
        self.file, self.start, self.end = file, start, end


class LogTail(DataSourceStreamReader):
    def __init__(self, path: str, suffix: str):
        self.path, self.suffix = path, suffix

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        system, folder = _open(self.path)
        out = {}
        for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True, recursive=True)):
            if info.is_file and info.base_name.endswith(self.suffix) and not info.base_name.startswith((".", "_")):
                with system.open_input_file(info.path) as held:
                    out[info.path] = _line_end(held, info.size)
        return out

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        out = []
        system, _ = _open(self.path)
        for file, upto in sorted(end.items()):
            at = start.get(file, 0)
            at = 0 if at > upto else at
            while at < upto:
                stop = upto
                if upto - at > PIECE_BYTES:
                    with system.open_input_file(file) as held:
                        stop = _line_end(held, at + PIECE_BYTES)
                    stop = upto if stop <= at else stop  # a line longer than a piece
                out.append(Piece(file, at, stop))
                at = stop
        return out

    def read(self, partition: Piece) -> Iterator[tuple]:
        system, _ = _open(self.path)
        with system.open_input_file(partition.file) as held:
            data = held.read_at(partition.end - partition.start, partition.start)
        at = partition.start
        for line in data.split(b"\n")[:-1]:
            yield partition.file, at, line.removesuffix(b"\r").decode("utf-8", "replace")
            at += len(line) + 1

    def commit(self, end: dict) -> None:
        pass


class LogTailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> LogTail:
        return LogTail(self.options["path"], self.options.get("suffix", ""))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogTailSource)
