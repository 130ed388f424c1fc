"""A folder of journals as a stream: a Python data source whose offsets are bytes of files.

    spark.dataSource.register(JournalLines)
    spark.readStream.format("journal_lines").option("path", folder).load()

An offset says of each file up to which byte whole lines were there, and a hash of the last bytes before it. A batch is the
bytes between two offsets, in ranges of many tasks, so that a batch that is tried again reads the same bytes. Where a
file no longer holds the bytes that were read (it was rewritten, or cut short), it is read from its start and its rows say
so (rewritten): what was read of it before is to be replaced.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tallywheel.sources.lines import READ, SPLIT, files_under, lines_between, opened, stat

SCHEMA = "source_key string, path string, modified_unix_ms bigint, record_offset bigint, line string, rewritten boolean"
#: Bytes before an offset that must still be there for reading to go on.
WINDOW = 1 << 16


@dataclass
class Range(InputPartition):
    source_key: str
    path: str
    modified_unix_ms: int
    begin: int
    low: int
    high: int
    rewritten: bool


def window_hash(path: str, at: int) -> str | None:
    """The hash of the last WINDOW bytes before a place; None if the file doesn't reach it."""
    seen = stat(path)
    if seen is None or seen[0] < at:
        return None
    with opened(path) as file:
        file.seek(max(0, at - WINDOW))
        return hashlib.sha256(file.read(min(at, WINDOW))).hexdigest()


def whole_end(path: str, size: int) -> int:
    """The byte after the last line end among the first `size` bytes, sought from the back."""
    with opened(path) as file:
        high = size
        while high > 0:
            low = max(0, high - READ)
            file.seek(low)
            found = file.read(high - low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            high = low
    return 0


class JournalStream(DataSourceStreamReader):
    def __init__(self, options):
        self.root, self.pattern = options["path"].rstrip("/"), options.get("pattern", "*.jsonl")
        self.split = int(options.get("split", SPLIT))
        self.known: dict[str, tuple] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """{file: {"at": bytes, "check": hash}}; a file of unchanged size and time is not opened."""
        out = {}
        for path in map(str, files_under(self.root, self.pattern)):
            seen = stat(path)
            if seen is None:
                continue
            if path not in self.known or self.known[path][0] != seen:
                at = whole_end(path, seen[0])
                self.known[path] = (seen, {"at": at, "check": window_hash(path, at) or ""})
            out[path[len(self.root) + 1 :]] = self.known[path][1]
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        ranges = []
        for key, to in end.items():
            path, was = f"{self.root}/{key}", start.get(key)
            if was == to:
                continue
            rewritten = was is not None and was["at"] > 0 and (was["at"] > to["at"] or window_hash(path, was["at"]) != was["check"])
            begin = was["at"] if was is not None and not rewritten else 0
            modified = (stat(path) or (0, 0))[1] // 1_000_000
            ranges += [Range(key, path, modified, begin, low, min(low + self.split, to["at"]), rewritten) for low in range(begin, to["at"], self.split)]
        return ranges

    def read(self, partition: Range):
        with opened(partition.path) as file:
            for places, lines, ended in lines_between(file, partition.begin, partition.low, partition.high):
                kept = [(at, line.decode("utf-8", "replace")) for at, line in zip(places, lines, strict=True) if ended and line.strip()]
                if kept:
                    same = lambda value, kind, n=len(kept): pa.array([value] * n, kind)
                    columns = [same(partition.source_key, pa.string()), same(partition.path, pa.string()), same(partition.modified_unix_ms, pa.int64()), pa.array([at for at, _ in kept], pa.int64()), pa.array([x for _, x in kept], pa.string()), same(partition.rewritten, pa.bool_())]
                    yield pa.RecordBatch.from_arrays(columns, names=["source_key", "path", "modified_unix_ms", "record_offset", "line", "rewritten"])


class JournalLines(DataSource):
    """Options: path (a folder, local or a URI), pattern (of file names; *.jsonl), split (bytes of a range)."""

    @classmethod
    def name(cls) -> str:
        return "journal_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> JournalStream:
        return JournalStream(self.options)
