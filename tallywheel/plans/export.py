"""Exports for people: one JSON or CSV file without paths, notes or content."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywheel.functions.identity import fnv1a64
from tallywheel.plans.queries import EXPORT_COLUMNS, export_rows
from tallywheel.schema import BUCKETS

FORMAT = "usage-events-v1"
RECONCILIATION_FORMAT = 1
#: The names that exported fields have in JSON.
JSON_NAMES = {
    "event_id": "eventId", "session_id": "sessionId", "occurred_at_unix_ms": "occurredAtUnixMs", "client": "client", "provider": "provider", "model": "model", "total_tokens": "totalTokens",
    "source_reported_total": "sourceReportedTotal", "confidence": "confidence", "provider_reported_usd": "providerReportedUsd", "api_equivalent_estimate_usd": "apiEquivalentEstimateUsd", "unpriced": "unpriced",
    "pricing_key": "pricingKey", "pricing_rule": "pricingRule",
}


def ordered(facts: DataFrame) -> DataFrame:
    return export_rows(facts).orderBy("occurred_at_unix_ms", "source_object_id", "event_id").select(*EXPORT_COLUMNS)


def json_lines(facts: DataFrame) -> DataFrame:
    """One JSON object an event, for the distributed writer."""
    tokens = F.struct(*(F.col(b).alias(b.removesuffix("_tokens").replace("_read", "Read").replace("_write", "Write")) for b in BUCKETS))
    rows = ordered(facts).select(*(F.col(c).alias(n) for c, n in JSON_NAMES.items()), tokens.alias("tokens"))
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("event"))


def _write(lines: DataFrame, path: Path, head: bytes, tail: bytes, between: bytes = b"") -> int:
    """One file of head, all lines in their order, and tail; `between` is put before each line, without its first byte before the
    first one. Returns the number of lines.

    lines: one column of text in order. Tasks write each part of the rows as a file beside the path, and copy it to its place
    in the one file; the driver gets a row a part. The folder is one that the driver and all executors see.
    """
    base, drafts = str(path), f"{path}.parts-{uuid.uuid4().hex}"
    os.makedirs(drafts)

    def parts(batches):
        number, count, size, mine = TaskContext.get().partitionId(), 0, 0, f"{uuid.uuid4().hex}"
        with open(f"{drafts}/{mine}", "wb") as out:
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    rows = batch.column(0).slice(at, 4096).cast(pa.binary()).to_pylist()
                    size += out.write(b"".join([between + row for row in rows]))
                    count += len(rows)
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([mine]), pa.array([size], pa.int64()), pa.array([count], pa.int64())], names=["part", "file", "size", "count"])

    kind = "part long, file string, size long, count long"
    made = sorted(r[:] for r in lines.mapInArrow(parts, kind).collect() if r["count"])  # a row a part
    places, end, skip = [], len(head), min(1, len(between))
    for _, file, size, _ in made:
        places.append((file, skip, end))
        end, skip = end + size - skip, 0
    with open(base, "wb") as out:
        out.write(head)
        out.truncate(end)
        out.seek(end)
        out.write(tail)

    def copied(batches):
        for batch in batches:
            for file, skip, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with open(f"{drafts}/{file}", "rb") as part, open(base, "r+b") as out:
                    part.seek(skip)
                    out.seek(at)
                    shutil.copyfileobj(part, out, 1 << 20)
            yield batch.slice(0, 0)

    if places:
        rows = lines.sparkSession.createDataFrame(places, "file string, skip long, at long")
        rows.repartition(len(places)).mapInArrow(copied, rows.schema).write.format("noop").mode("overwrite").save()
    shutil.rmtree(drafts)
    return sum(count for *_, count in made)


def write_json(facts: DataFrame, path: Path, now_ms: int) -> int:
    """An envelope with all events."""
    count = facts.count()
    head = json.dumps({"format": FORMAT, "generatedAtUnixMs": now_ms, "eventCount": count})[:-1] + ', "events": ['
    _write(json_lines(facts), path, head.encode(), b"\n]}\n", b",\n")
    return count


def _csv(column: str, kind: str):
    """A value as CSV: quoted where it must be."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.when(text.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text) if kind == "string" else text


def csv_lines(facts: DataFrame) -> DataFrame:
    """One line an event."""
    rows = ordered(facts)
    return rows.select(F.concat(F.concat_ws(",", *(_csv(c, kind) for c, kind in rows.dtypes)), F.lit("\n")).alias("line"))


def write_csv(facts: DataFrame, path: Path) -> int:
    """A header and one line an event; a value is quoted only where it must be."""
    return _write(csv_lines(facts), path, (",".join(EXPORT_COLUMNS) + "\n").encode(), b"")


def export(facts: DataFrame, folder: str | Path, kind: str, now_ms: int) -> tuple[Path, int]:
    """Writes events-<UTC time>-<hash of the content>.<kind>; the same ledger at the same time gives the same name."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    draft = folder / f".draft-{now_ms}.{kind}"
    count = write_json(facts, draft, now_ms) if kind == "json" else write_csv(facts, draft)
    stamp = facts.sparkSession.range(1).select(F.date_format(F.timestamp_millis(F.lit(now_ms).cast("long")), "yyyyMMdd-HHmmss")).first()[0]
    digest = fnv1a64(b"")
    with draft.open("rb") as f:
        while block := f.read(1 << 20):
            digest = fnv1a64(block, digest)
    path = folder / f"events-{stamp}-{digest:016x}.{kind}"
    draft.replace(path)
    return path, count


def write_reconciliation(sources: DataFrame, checks: DataFrame, path: str | Path, now_ms: int) -> int:
    """The reconciliation report: report_sources() and cross_check() as one versioned document without paths or content.

    Rows come to the driver one by one, in their order; returns the number of sources.
    """
    count = 0
    with Path(path).open("w", encoding="utf-8") as f:
        f.write(json.dumps({"format": RECONCILIATION_FORMAT, "generatedAtUnixMs": now_ms})[:-1])
        for name, rows in (("sources", sources), ("referenceChecks", checks)):
            f.write(f', "{name}": [')
            for n, r in enumerate(rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})).toLocalIterator()):
                f.write((",\n" if n else "\n") + r[0])
                count += name == "sources"
            f.write("\n]")
        f.write("}\n")
    return count
