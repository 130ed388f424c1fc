"""Incremental reading: journals resumed at the byte where the last scan ended, and a projection kept by a stream."""

from __future__ import annotations

import threading
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywheel.operators.ledger import Checkpoint, Commit, Ledger, status_of
from tallywheel.operators.pricing import RateDataset
from tallywheel.plans import queries as Q
from tallywheel.sources.lines import Candidate, digests, stat
from tallywheel.sources.readers import Reader
from tallywheel.tables import settled

DAY_MS = 86_400_000
#: Sources that go into the ledger in one commit; a cancelled scan keeps the commits before.
COMMIT_SOURCES = 256


class Cancelled(RuntimeError):
    """The scan was asked to stop; what it had committed stays."""


@dataclass
class Scan:
    """What a scan did so far. cancel may be set by another thread; it is looked at between commits. progress is called
    with the scan itself after each discovery and each commit."""

    cancel: threading.Event = field(default_factory=threading.Event)
    progress: Callable[[Scan], None] | None = None
    discovered: int = 0
    processed: int = 0
    failed: list[str] = field(default_factory=list)
    inserted: int = 0
    duplicates: int = 0
    deleted: int = 0

    def tell(self) -> None:
        if self.progress is not None:
            self.progress(self)


def resumable(reader: Reader, c: Candidate) -> bool:
    return reader.resumable and not c.path.endswith(".zst")


def start_of(reader: Reader, c: Candidate, row, state: tuple[int, str, str | None], due: bool, now_ms: int, full_every_ms: int) -> tuple[str, int] | None:
    """(mode, offset) for a source: append from the start or where it ended, replace from the start; None if there is nothing new.

    row: the source in source_objects; state: the file's size, hash and hash up to where it was read (see digests()). Only
    a file that still begins with the bytes that were read goes on where it ended.
    """
    status, checkpoint = status_of(row, reader.parser_version)
    size, whole, prefix = state
    if not resumable(reader, c):
        if status == "current" and not due and checkpoint.fingerprint == whole:
            return None
        return "replace", 0
    if status == "never_ingested":
        return "append", 0
    offset = checkpoint.byte_offset if checkpoint else None
    if offset is None or checkpoint.prefix_fingerprint is None or size < offset or prefix != checkpoint.prefix_fingerprint:
        return "replace", 0
    if offset and due and row["last_success_unix_ms"] <= now_ms - full_every_ms:
        return "replace", 0
    return None if size == offset else ("append", offset)


def unchanged(reader: Reader, row, now: tuple[int, int]) -> bool:
    """Whether a file is as it was when its source was last read, by size and modification time: then nothing of it is read."""
    status, checkpoint = status_of(row, reader.parser_version)
    return status == "current" and row["last_error"] is None and (checkpoint.source_len, checkpoint.modified_ns) == now


def _parted(message: str) -> tuple[str, str]:
    """A warning "[kind] text" as (kind, text)."""
    kind, _, text = message[1:].partition("] ")
    return kind, text


def scan(ledger: Ledger, readers: Sequence[tuple[str, Reader]], now_ms: int, scan_: Scan | None = None, dataset: RateDataset | None = None, full_every_ms: int = DAY_MS, commit_sources: int = COMMIT_SOURCES) -> Scan:
    """Reads everything that is new into the ledger: (installation id, reader) pairs, one plan for each reader.

    A file of the same size and time as before is not opened; of one that grew, the bytes before are hashed and the lines
    after are read, with what the reader left to know (Batch.states); one that was rewritten replaces its events; a source
    whose last full read is older than full_every_ms is read whole (a first read counts as one). A file that disappears keeps
    its events. A source that fails is recorded and doesn't stop the others; candidates of a kind that the reader doesn't
    read fail. commit_sources sources go into the ledger at a time. Estimates are renewed last.
    """
    spark, state = ledger.spark, scan_ or Scan()
    for installation, reader in readers:
        found = reader.discover(spark)
        state.discovered += len(found)
        state.tell()
        if not found:
            continue
        root = str(getattr(reader, "root", getattr(reader, "home", getattr(reader, "path", ""))))
        ids = {c.source_key: f"{reader.id}:{c.source_key}" for c in found}
        # Rows of this reader's files: as many as were discovered.
        objects = lambda: {r["id"]: r for r in ledger.table("source_objects").filter(F.col("id").startswith(f"{reader.id}:")).collect()}  # noqa: B023, E731
        known = objects()
        if new := [{"id": ids[c.source_key], "native_path": c.path, "kind": c.kind, "parser_version": reader.parser_version} for c in found if ids[c.source_key] not in known]:
            ledger.register_sources({"id": installation, "adapter_id": reader.id, "root_path": root}, new)
            known = objects()
        if ledger.table("source_installations").filter((F.col("id") == installation) & ~F.col("enabled")).limit(1).count():
            continue
        due = {r["source_object_id"] for r in Q.due_sources(ledger.table("source_objects"), ledger.table("source_installations"), ledger.table("ingest_runs"), now_ms, full_every_ms).collect()}
        row = lambda c: known[ids[c.source_key]]  # noqa: B023, E731
        late = lambda c: ids[c.source_key] in due and (row(c)["last_success_unix_ms"] or 0) <= now_ms - full_every_ms  # noqa: B023, E731
        there = {c.source_key: stat(c.path) for c in found}
        broken = {c.source_key: f"[schema] {reader.id} doesn't read {c.kind}" for c in found if c.kind not in reader.kinds} | {k: "[io] the file is gone" for k, s in there.items() if s is None}
        failures = [(ids[k], *_parted(said)) for k, said in broken.items()]
        changed = [c for c in found if c.source_key not in broken and (late(c) or not unchanged(reader, row(c), there[c.source_key]))]
        states = digests(spark, {c.path: row(c)["byte_offset"] for c in changed})
        plan = {c.source_key: start_of(reader, c, row(c), states[c.path], ids[c.source_key] in due, now_ms, full_every_ms) for c in changed}
        wanted = [c for c in changed if plan[c.source_key]]
        if wanted:
            begins = {k: p[1] for k, p in plan.items() if p and p[1]}
            batch = reader.read(spark, wanted, begins or None, {c.source_key: row(c)["parser_state"] for c in wanted if c.source_key in begins and row(c)["parser_state"]} or None)
            # By the ledger's ids: the records' own are the files' keys. Written once: every step of a commit reads them.
            records = settled(batch.records.withColumn("source_object_id", F.concat(F.lit(f"{reader.id}:"), "source_object_id")), "scan-records", batch.kept)
            # As many as there are odd lines: they stay a table, of which the driver gets what bars a file (of several, the first by its byte).
            warnings = settled(batch.warnings.select(F.concat(F.lit(f"{reader.id}:"), "source_key").alias("source_object_id"), "warning"), "scan-warnings", batch.kept)
            fatal = F.when(F.col("warning").rlike(r"^\[(schema|encoding|io)\]"), F.struct(F.length("warning"), "warning"))
            said = {r["source_object_id"]: r["fatal"] for r in warnings.groupBy("source_object_id").agg(F.min(fatal)["warning"].alias("fatal")).collect()}
            ends = {r["source_key"]: r["committed_offset"] for r in batch.ends.collect()} if batch.ends is not None else {}
            ends = {c.source_key: ends.get(c.source_key) if resumable(reader, c) else None for c in wanted}
            left = {r["source_key"]: r["state"] for r in batch.states.collect()} if batch.states is not None else {}
            # A file without a byte to resume at has the hash from before it was read: if it changed since, it is read again.
            states |= digests(spark, {c.path: ends[c.source_key] for c in wanted if ends[c.source_key] is not None})
            commits = []
            for c in wanted:
                source, (_, whole, prefix) = ids[c.source_key], states[c.path]
                if said.get(source):
                    failures.append((source, *_parted(said[source])))
                else:
                    size, modified = there[c.source_key]
                    goes_on = ends[c.source_key] is not None
                    commits.append(Commit(source, plan[c.source_key][0], Checkpoint(ends[c.source_key], size, prefix if goes_on else None, whole, reader.parser_version, modified, left.get(c.source_key) if goes_on else None)))
            try:
                for at in range(0, len(commits), commit_sources):
                    if state.cancel.is_set():
                        raise Cancelled(f"stopped after {state.processed} sources")
                    some = commits[at : at + commit_sources]
                    for source, report in ledger.apply_all(some, records, now_ms, warnings if any(c.source in said for c in some) else None).items():
                        if isinstance(report, Exception):
                            state.failed.append(source)
                            continue
                        state.processed += 1
                        state.inserted += report.inserted
                        state.duplicates += report.duplicates
                        state.deleted += report.deleted
                    state.tell()
            finally:
                batch.forget()
        ledger.fail_all(failures, now_ms)
        state.failed += [f[0] for f in failures]
    if dataset is not None and (state.inserted or state.deleted):
        ledger.price_changed(dataset, now_ms)
    return state


def stream_daily(events: DataFrame, path: str, checkpoint: str):
    """A streaming query that keeps the daily projection of an event stream at path, each micro-batch merged once.

    events: a streaming DataFrame of usage_events rows. Late rows change their own day. Each merge writes a version of
    its own; a batch that is tried again rewrites the same version.
    """
    spark = events.sparkSession
    kind = "day string, client string, provider string, model string, " + ", ".join(f"{b} bigint" for b in Q.BUCKETS) + ", event_count bigint"

    def merge(batch: DataFrame, number: int) -> None:
        old = read_daily(spark, path, number, kind)
        Q.merge_daily(old, Q.daily_usage(batch)).write.mode("overwrite").parquet(f"{path}/v={number}")

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def read_daily(spark: SparkSession, path: str, before: int | None = None, kind: str | None = None) -> DataFrame:
    """The projection's newest version (below a batch number)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    versions = sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))
    versions = [v for v in versions if before is None or v < before]
    if not versions:
        return spark.createDataFrame([], kind)
    return spark.read.parquet(f"{path}/v={versions[-1]}")
