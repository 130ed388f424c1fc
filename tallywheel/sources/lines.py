"""Line files as DataFrames: every line of every file with the byte at which it begins.

Files are cut into ranges of bytes, and each range is read by the task that owns it: a task seeks to its range and takes
the lines that begin there, so that a file of any size is read by many tasks and every line knows its place without a sum
over those before it. What begins before the range belongs to the task before, even if it ends inside. Compressed files
are one range, read as a stream. Files are local ones or URIs of a file system that pyarrow knows.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywheel.tables import forget, settled

LINES = "source_key string, path string, modified_unix_ms bigint, record_offset bigint, line binary, ended boolean, error string"
#: Bytes of a range, and bytes read at a time.
SPLIT, READ = 64 << 20, 1 << 20


@dataclass(frozen=True)
class Candidate:
    """A file that a reader has discovered: its key (stable when the file moves) and its path."""

    source_key: str
    path: str
    kind: str = "append_only_jsonl"


@dataclass
class Batch:
    """What a reader made of files: records (schema.RECORD, source_object_id = source_key), warnings (source_key, warning),
    for each file the byte up to which whole lines were read (ends), and what the reader has to know to go on there
    (states: source_key, state). forget() deletes the tables that the plans read."""

    records: DataFrame
    warnings: DataFrame
    ends: DataFrame | None = None
    states: DataFrame | None = None
    kept: list[DataFrame] = field(default_factory=list)

    def forget(self) -> None:
        forget(*self.kept)


# -- files


def opened(path: str):
    """A file to read and seek in, by its local path or by a URI."""
    if "://" not in path:
        return open(path, "rb")
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path)
    return system.open_input_file(place)


def stat(path: str | Path) -> tuple[int, int] | None:
    """(size, modification time in ns) of a file; None if there is none."""
    path = str(path)
    if "://" not in path:
        try:
            s = os.stat(path)
        except OSError:
            return None
        return (s.st_size, s.st_mtime_ns) if os.path.isfile(path) else None
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path)
    info = system.get_file_info(place)
    return (info.size, info.mtime_ns or 0) if info.type == fs.FileType.File else None


def files_under(root: str | Path, pattern: str, recursive: bool = True) -> list:
    """The files under a folder whose names match a pattern, in the order of their paths: one listing of the file system."""
    if "://" in str(root):
        from fnmatch import fnmatchcase

        from pyarrow import fs

        system, place = fs.FileSystem.from_uri(str(root))
        prefix = str(root)[: len(str(root).rstrip("/")) - len(place.rstrip("/"))]
        found = system.get_file_info(fs.FileSelector(place, allow_not_found=True, recursive=recursive))
        return sorted(prefix + x.path for x in found if x.type == fs.FileType.File and fnmatchcase(x.base_name, pattern))
    root = Path(root).expanduser()
    if not root.is_dir():
        return []
    return sorted(p for p in (root.rglob(pattern) if recursive else root.glob(pattern)) if p.is_file())


def _spread(spark: SparkSession, rows: list, kind: str, weight: int) -> DataFrame:
    """Driver-made rows (a row for each range or file) over as many tasks as their bytes are worth."""
    tasks = max(1, min(len(rows), max(spark.sparkContext.defaultParallelism, weight // SPLIT)))
    return spark.createDataFrame(rows, kind).repartition(tasks)


# -- lines


def lines_between(file, begin: int, low: int, high: int | None) -> Iterator[tuple[list[int], list[bytes], bool]]:
    """(places, lines, whether they ended) of the lines that begin in [low, high), the file's own from byte `begin` on.

    A range that doesn't begin the file looks for the line end at or after the byte before it.
    """
    inside = low > begin
    at, rest = (low - 1 if inside else low), b""
    if at:
        file.seek(at)
    while block := file.read(READ):
        if inside:
            first = block.find(b"\n")
            if first < 0:
                at += len(block)
                if high is not None and at >= high:
                    return
                continue
            at, block, inside = at + first + 1, block[first + 1 :], False
        if b"\n" not in block:
            rest += block
            continue
        *lines, rest = (rest + block).split(b"\n")
        places = []
        for line in lines:
            if high is not None and at >= high:
                break
            places.append(at)
            at += len(line) + 1
        if places:
            yield places, lines[: len(places)], True
        if high is not None and at >= high:
            return
    if rest and not inside and (high is None or at < high):
        yield [at], [rest], False


def _read(batches):
    for batch in batches:
        for key, path, modified, begin, low, high in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):

            def out(places, lines, ended, error=None, key=key, path=path, modified=modified):
                n = len(places)
                columns = [pa.array([key] * n), pa.array([path] * n), pa.array([modified] * n, pa.int64()), pa.array(places, pa.int64()), pa.array(lines, pa.binary()), pa.array([ended] * n), pa.array([error] * n, pa.string())]
                return pa.RecordBatch.from_arrays(columns, names=["source_key", "path", "modified_unix_ms", "record_offset", "line", "ended", "error"])

            try:
                with opened(path) as file:
                    if path.endswith(".zst"):
                        import zstandard

                        with zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True) as text:
                            held = 0
                            for places, lines, ended in lines_between(text, 0, 0, None):
                                held += len(places)
                                yield out(places, lines, ended)
                    else:
                        for places, lines, ended in lines_between(file, begin, low, high):
                            yield out(places, lines, ended)
            except Exception as why:  # a file that can't be read fails alone, whatever its format's library raises
                yield out([low], [None], False, f"[io] {why}")


def raw_lines(spark: SparkSession, candidates: Sequence[Candidate], offsets: dict[str, int] | None = None, split: int | None = None, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(lines as in LINES, files (source_key, begin)) of files, each from its offset on; most: only lines that begin before it."""
    split, ranges, files, weight = split or SPLIT, [], [], 0
    for c in candidates:
        size, modified = stat(c.path) or (0, 0)
        begin = 0 if c.path.endswith(".zst") else (offsets or {}).get(c.source_key, 0)
        end = size if most is None else min(size, begin + most)
        files.append((c.source_key, begin))
        weight += max(0, end - begin)
        cuts = [begin] if c.path.endswith(".zst") else range(begin, max(end, begin + 1), split)
        ranges += [(c.source_key, c.path, modified // 1_000_000, begin, low, None if c.path.endswith(".zst") else min(low + split, max(end, begin + 1))) for low in cuts]
    kind = "source_key string, path string, modified_unix_ms bigint, begin bigint, low bigint, high bigint"
    rows = _spread(spark, ranges, kind, weight) if ranges else spark.createDataFrame([], kind)
    return rows.mapInArrow(_read, LINES), spark.createDataFrame(files, "source_key string, begin bigint")


def read_lines(spark: SparkSession, candidates: Sequence[Candidate], offsets: dict[str, int] | None = None, kept: list[DataFrame] | None = None, **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, warnings, ends) of files, each from its offset on; the files are read once.

    Only lines that end are lines; what follows the last end is left for later, with a warning. Blank lines are passed
    over. ends: (source_key, committed_offset). A file that can't be read, or isn't UTF-8, has a warning of kind [io] or
    [encoding].
    """
    raw, files = raw_lines(spark, candidates, offsets, **how)
    raw = settled(raw, "lines", kept)
    stop = F.max(F.when(F.col("ended"), F.col("record_offset") + F.octet_length("line") + 1)).alias("stop")
    ends = files.join(raw.groupBy("source_key").agg(stop), "source_key", "left").select("source_key", F.coalesce("stop", "begin").alias("committed_offset"))
    text = F.col("line").cast("string")
    valid = F.is_valid_utf8(text)
    problem = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(~F.col("ended"), F.format_string("the line that begins at byte %d has no end yet; it is read once it has one", "record_offset"))
        .when(~valid, F.format_string("[encoding] bytes at %d are not UTF-8", "record_offset"))
    )
    warnings = raw.select("source_key", problem.alias("warning")).filter("warning IS NOT NULL")
    lines = raw.filter(F.col("ended") & valid).select("source_key", "path", "modified_unix_ms", "record_offset", text.alias("line")).filter(F.trim("line") != "")
    return lines, warnings, ends


# -- whole files


def digests(spark: SparkSession, offsets: dict[str, int | None]) -> dict[str, tuple[int, str, str | None]]:
    """By path: (size, SHA-256 of the file, SHA-256 of the bytes before the path's offset, or None), each file read as a
    stream by one task. A file that is gone has size 0. The driver gets a short row a file."""

    def run(batches):
        for batch in batches:
            for path, offset in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                whole, prefix, size = hashlib.sha256(), None, 0
                try:
                    with opened(path) as file:
                        while True:
                            left = None if offset is None or offset < size else offset - size
                            if left == 0:
                                prefix, left = whole.copy(), None
                                offset = None
                            block = file.read(READ if left is None else min(READ, left))
                            if not block:
                                break
                            whole.update(block)
                            size += len(block)
                except OSError:
                    whole, size, prefix = hashlib.sha256(), 0, hashlib.sha256() if offset is not None else None
                if offset is not None and prefix is None:  # the file is shorter than that
                    prefix = whole
                row = [[path], [size], [whole.hexdigest()], [prefix and prefix.hexdigest()]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["path", "size", "whole", "prefix"])

    if not offsets:
        return {}
    rows = _spread(spark, list(offsets.items()), "path string, offset bigint", sum((stat(p) or (0, 0))[0] for p in offsets))
    return {r["path"]: (r["size"], r["whole"], r["prefix"]) for r in rows.mapInArrow(run, "path string, size bigint, whole string, prefix string").collect()}


def whole_files(spark: SparkSession, candidates: Sequence[Candidate]) -> DataFrame:
    """(source_key, path, modified_unix_ms, text) for each candidate: documents, a row each."""

    def run(batches):
        for batch in batches:
            for key, path, modified in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                with opened(path) as file:
                    text = file.read()
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([path]), pa.array([modified], pa.int64()), pa.array([text], pa.binary())], names=["source_key", "path", "modified_unix_ms", "text"])

    rows, weight = [], 0
    for c in candidates:
        size, modified = stat(c.path) or (0, 0)
        rows.append((c.source_key, c.path, modified // 1_000_000))
        weight += size
    kind = "source_key string, path string, modified_unix_ms bigint"
    files = _spread(spark, rows, kind, weight) if rows else spark.createDataFrame([], kind)
    return files.mapInArrow(run, f"{kind}, text binary").withColumn("text", F.col("text").cast("string"))


# -- warnings


def collected(rows: DataFrame, column: str = "warnings") -> DataFrame:
    """(source_key, warning) from a column with an array of warnings."""
    return rows.select("source_key", F.explode(F.filter(column, lambda x: x.isNotNull())).alias("warning"))
