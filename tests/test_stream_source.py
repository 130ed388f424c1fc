"""The stream of journals: appended bytes are a batch, a rewritten file says so, a restart loses and repeats nothing."""

import os

import pytest

from tallywheel.sources import stream
from tallywheel.sources.stream import JournalLines, JournalStream


@pytest.fixture
def feed(spark, tmp_path):
    spark.dataSource.register(JournalLines)
    root, out, marks = tmp_path / "in", tmp_path / "out", tmp_path / "marks"
    root.mkdir()
    clock = [10**18]

    def write(name, text, mode="a"):
        with open(root / name, mode + "b") as f:
            f.write(text.encode())
        clock[0] += 10**9
        os.utime(root / name, ns=(clock[0], clock[0]))

    def run():
        """The rows of one run over what is new, in the order of their places."""
        before = {tuple(r) for r in spark.read.parquet(str(out)).collect()} if out.exists() and any(out.glob("*.parquet")) else set()
        rows = spark.readStream.format("journal_lines").option("path", str(root)).option("split", "7").load()
        query = rows.select("source_key", "record_offset", "line", "rewritten").writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(marks)).trigger(availableNow=True).start()
        query.awaitTermination()
        after = [tuple(r) for r in spark.read.parquet(str(out)).collect()] if any(out.glob("*.parquet")) else []
        assert len(after) == len(set(after))
        return sorted(set(after) - before)

    return root, write, run


def test_appends_rewrites_and_restarts(feed):
    _, write, run = feed
    write("a.jsonl", "one\nzwei é\n\nthr")
    write("b.jsonl", "x\n")
    assert run() == [("a.jsonl", 0, "one", False), ("a.jsonl", 4, "zwei é", False), ("b.jsonl", 0, "x", False)]
    assert run() == []  # each run is a restart from the log
    write("a.jsonl", "ee\nfour\n")
    write("c.jsonl", "new\n")
    assert run() == [("a.jsonl", 13, "three", False), ("a.jsonl", 19, "four", False), ("c.jsonl", 0, "new", False)]
    write("a.jsonl", "other\nlines\nof the same file\n", "w")
    assert run() == [("a.jsonl", 0, "other", True), ("a.jsonl", 6, "lines", True), ("a.jsonl", 12, "of the same file", True)]
    write("b.jsonl", "", "w")  # cut short: nothing to read, and what comes then is read from the start
    assert run() == []
    write("b.jsonl", "y\n")
    assert run() == [("b.jsonl", 0, "y", False)]
    assert run() == []


def test_a_batch_tried_again_reads_the_same(feed):
    root, write, _ = feed
    write("a.jsonl", "one\ntwo\n")
    reader = JournalStream({"path": str(root), "split": "3"})
    start = reader.latestOffset()
    write("a.jsonl", "three\n")
    end = reader.latestOffset()
    write("a.jsonl", "four\n")  # after the batch was planned
    again = JournalStream({"path": str(root), "split": "3"})  # another driver
    for r in (reader, again):
        lines = [x for p in r.partitions(start, end) for b in r.read(p) for x in b.column("line").to_pylist()]
        assert lines == ["three"]
    assert again.partitions(end, end) == []


def test_unchanged_files_are_not_opened(feed, monkeypatch):
    root, write, _ = feed
    write("a.jsonl", "one\n")
    reader = JournalStream({"path": str(root)})
    first = reader.latestOffset()
    monkeypatch.setattr(stream, "opened", lambda path: pytest.fail(path))
    assert reader.latestOffset() == first
