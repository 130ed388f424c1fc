"""The ledger: versioned snapshots of Parquet tables with an atomic pointer, and exactly-once source-owned writes.

A commit writes the tables that it changes under a new version folder and then replaces the pointer file; readers see
either the old ledger or the new one. Conflicts are sought before anything is published, so a batch goes in whole or
not at all. There is one writer at a time.

Events, provenance and costs are partitioned by source, the unit of ownership: an append adds files of its source, a
replacement rewrites that source only; the manifest in the pointer says which folders make up a table. A commit takes
many sources at once: its jobs are those of one source. With the events it publishes the daily projection, by month, and
the sessions, by source.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywheel import schema
from tallywheel.functions import timeutil
from tallywheel.operators import pricing
from tallywheel.plans import queries as Q
from tallywheel.schema import ESTIMATE, REPORTED, TABLES, UNPRICED
from tallywheel.tables import forget, settled

#: Tables in parts that are rewritten alone, by the column that names the part.
OWNED = {"usage_events": "source_object_id", "event_provenance": "source_object_id", "event_costs": "source_object_id", "session_parts": "source_object_id", "daily_usage_utc": "month"}
#: Appends add their sessions as files of their own; so many, and a source's are written anew as one.
MOST_PARTS = 16
KEY = ["source_object_id", "event_id"]


class IdentityConflict(ValueError):
    """A source shows an event again with other facts."""


class InvalidRecord(ValueError):
    """A record that the ledger's constraints forbid."""


@dataclass
class Checkpoint:
    byte_offset: int | None = None
    source_len: int = 0
    prefix_fingerprint: str | None = None
    fingerprint: str | None = None
    parser_version: int = 1
    modified_ns: int | None = None
    parser_state: str | None = None


@dataclass
class Commit:
    """What is to become of one source: append or replace, the place up to which it was read, what the run log is to say.

    warnings: a few, in the caller's order; those of a reader, which may be many, are rows that apply_all() takes.
    """

    source: str
    mode: str = "append"
    checkpoint: Checkpoint = field(default_factory=Checkpoint)
    warnings: list[str] = field(default_factory=list)


@dataclass
class IngestReport:
    source_object_id: str
    mode: str
    seen: int = 0
    inserted: int = 0
    duplicates: int = 0
    deleted: int = 0
    warnings: list[str] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(self.__dict__, indent=2)


def status_of(row, parser_version: int) -> tuple[str, Checkpoint | None]:
    """What a row of source_objects says: never_ingested, current (with the checkpoint) or invalidated (another parser wrote it)."""
    if row is None or row["last_success_unix_ms"] is None:
        return "never_ingested", None
    if row["parser_version"] != parser_version:
        return "invalidated", None
    return "current", Checkpoint(row["byte_offset"], row["source_len"], row["prefix_fingerprint"], row["fingerprint"], row["parser_version"], row["modified_ns"], row["parser_state"])


def compare_again(stored: DataFrame, again: DataFrame, facts: Sequence[str], keys: Sequence[str] = tuple(KEY)) -> DataFrame:
    """The events of `again` that are stored already, with conflict: whether any fact differs (null equals null)."""
    said = F.to_json(F.struct(*facts))  # as text: what may be null differs between a batch and the ledger
    # Events meet events by a shuffle: a Parquet file is small beside its rows, so that by its size Spark would broadcast it.
    theirs = stored.select(*keys, said.alias("__stored"))
    both = again.join(theirs.hint("merge"), list(keys))
    return both.withColumn("conflict", said != F.col("__stored")).drop("__stored")


def problem_of() -> Column:
    """Why the ledger refuses a record; null if it doesn't."""
    counts = F.array(*(F.col(b) for b in schema.BUCKETS))
    usd_needed = F.exists("costs", lambda c: c.kind.isin(REPORTED, ESTIMATE) & c.usd_nanos.isNull())
    usd_forbidden = F.exists("costs", lambda c: c.kind.isin(schema.CREDIT, UNPRICED) & c.usd_nanos.isNotNull())
    return (
        F.when(F.col("event_id").isNull() | F.col("client").isNull() | F.col("model").isNull() | F.col("occurred_at_unix_ms").isNull(), "a required field is missing")
        .when(F.exists(counts, lambda n: n.isNull() | (n < 0)) | (F.col("source_reported_total") < 0), "a token count is missing or negative")
        .when(~F.col("confidence").isin(*schema.CONFIDENCE), "unknown confidence")
        .when(usd_needed, "a cost has no amount")
        .when(usd_forbidden, "a credit or unpriced mark has an amount")
        .when(F.exists("costs", lambda c: c.usd_nanos < 0), "a cost is negative")
    )


def validate(records: DataFrame) -> DataFrame:
    """The records that the ledger refuses, with problem."""
    return records.withColumn("problem", problem_of()).filter("problem IS NOT NULL")


def part_of(source: str) -> str:
    """The folder of a source inside a table's: a hash, as ids may hold what paths may not."""
    return f"__part={hashlib.sha256(source.encode()).hexdigest()}"


class Ledger:
    """A ledger in a folder. Tables are DataFrames; writes go through append(), replace(), fail() and the registrations."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)
        state = self._state()
        if state["version"] > schema.VERSION:
            raise ValueError(f"the ledger has schema version {state['version']}; this reader knows {schema.VERSION}")

    # -- storage

    def _state(self) -> dict:
        pointer = self.folder / "pointer.json"
        return json.loads(pointer.read_text()) if pointer.exists() else {"version": schema.VERSION, "commit": 0, "tables": {}}

    def _publish(self, tables: dict, **more) -> None:
        state = self._state() | more
        state["tables"].update(tables)
        state["commit"] += 1
        draft = self.folder / f"pointer-{uuid.uuid4().hex}.json"
        draft.write_text(json.dumps(state))
        os.replace(draft, self.folder / "pointer.json")

    def _parts(self, name: str) -> dict[str, list[str]] | list[str]:
        return self._state()["tables"].get(name, {} if name in OWNED else [])

    def table(self, name: str) -> DataFrame:
        """The table as last published. A run has all its warnings, in one array; ingest_warnings has those of scans as rows."""
        out = self._stored(name)
        if name != "ingest_runs" or not self._parts("ingest_warnings"):
            return out
        # A subquery, which Spark leaves out where a run's warnings aren't asked for.
        said = self._stored("ingest_warnings").filter(F.col("run_id") == F.col("id").outer()).select(F.array_sort(F.collect_list("warning"))).scalar()
        return out.withColumn("warnings", F.concat("warnings", F.coalesce(said, F.array().cast("array<string>"))))

    def _stored(self, name: str) -> DataFrame:
        parts = self._parts(name)
        paths = [p for own in parts.values() for p in own] if isinstance(parts, dict) else parts
        kind = schema.struct(TABLES[name])
        if not paths:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*(str(self.folder / p) for p in paths))

    def owned(self, name: str, *sources: str) -> DataFrame:
        """Some sources' rows of a table."""
        parts, kind = self._parts(name), schema.struct(TABLES[name])
        paths = [str(self.folder / p) for s in sources for p in parts.get(s, [])]
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def _write(self, name: str, df: DataFrame) -> str:
        """A new folder of a table, relative to the ledger's; those of OWNED tables hold one folder a source."""
        path = f"data/{name}/{uuid.uuid4().hex}"
        df = df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.struct(TABLES[name]).fields))
        if name in OWNED:
            # Rows of a source come together, and Spark splits a source that is too large for one task.
            df = df.withColumn("__part", F.sha2(F.col(OWNED[name]).cast("binary"), 256)).hint("rebalance", "__part")
            df.write.partitionBy("__part").parquet(str(self.folder / path))
        else:
            df.write.parquet(str(self.folder / path))
        return path

    def _added(self, path: str, keys) -> dict[str, str]:
        """By key the folder of each part that a write has made; a key without rows has none."""
        made = {x.name for x in (self.folder / path).iterdir()}
        return {k: f"{path}/{part_of(k)}" for k in keys if part_of(k) in made}

    def _rewrite(self, name: str, df: DataFrame) -> list[str]:
        """A small table, whole."""
        return [self._write(name, df.coalesce(1))]

    # -- registrations

    def _upsert(self, name: str, rows: list[dict], keep: Sequence[str] = ()) -> None:
        """Rows by id; columns of `keep` stay as they are where the id is known."""
        kind = schema.struct(TABLES[name])
        new = self.spark.createDataFrame([[r.get(f.name) for f in kind.fields] for r in rows], kind)
        old = self.table(name)
        held = new.join(old.select("id", *(F.col(c).alias(f"__{c}") for c in keep)), "id", "left")
        held = held.select(*(F.coalesce(F.col(f"__{f.name}"), F.col(f.name)).alias(f.name) if f.name in keep else F.col(f.name) for f in kind.fields))
        self._publish({name: self._rewrite(name, old.join(new.select("id"), "id", "left_anti").unionByName(held))})

    def register_installation(self, id: str, adapter_id: str, root_path: str, enabled: bool = True, permission_state: str = "unknown", **rest) -> None:
        """Adds an installation, or overwrites it with its state."""
        self._upsert("source_installations", [{"id": id, "adapter_id": adapter_id, "root_path": root_path, "enabled": enabled, "permission_state": permission_state, **rest}])

    def register_installations(self, rows: Sequence[dict]) -> None:
        """Adds installations (id, adapter_id, root_path); those that are known keep their state."""
        self._upsert("source_installations", [{"enabled": True, "permission_state": "unknown", **r} for r in rows], keep=("enabled", "permission_state"))

    def register_source(self, id: str, installation: dict, native_path: str, kind: str = "append_only_jsonl", parser_version: int = 1) -> None:
        """Adds a source and its installation; the installation's state and the source's checkpoint are kept where they exist."""
        self.register_sources(installation, [{"id": id, "native_path": native_path, "kind": kind, "parser_version": parser_version}])

    def register_sources(self, installation: dict, sources: Sequence[dict]) -> None:
        """Adds the sources (id, native_path, kind, parser_version) of an installation, as register_source() does."""
        self._upsert("source_installations", [{"enabled": True, "permission_state": "unknown", **installation}], keep=("enabled", "permission_state"))
        checkpoint = ("fingerprint", "parser_version", "byte_offset", "source_len", "prefix_fingerprint", "last_scan_unix_ms", "last_success_unix_ms", "last_error", "modified_ns", "parser_state")
        self._upsert("source_objects", [{**s, "installation_id": installation["id"]} for s in sources], keep=checkpoint)

    def set_installation_state(self, id: str, enabled: bool, permission_state: str) -> None:
        rows = self.table("source_installations")
        mine = F.col("id") == id
        if rows.filter(mine).limit(1).count() == 0:
            raise KeyError(id)
        self._publish({"source_installations": self._rewrite("source_installations", rows.withColumns({"enabled": F.when(mine, enabled).otherwise(F.col("enabled")), "permission_state": F.when(mine, permission_state).otherwise(F.col("permission_state"))}))})

    def source_exists(self, source: str) -> bool:
        return self.table("source_objects").filter(F.col("id") == source).limit(1).count() > 0

    def checkpoint_status(self, source: str, parser_version: int) -> tuple[str, Checkpoint | None]:
        """never_ingested, current (with the checkpoint) or invalidated (another parser wrote it)."""
        return status_of(self.table("source_objects").filter(F.col("id") == source).first(), parser_version)

    # -- ingestion

    def _runs(self, reports: Sequence[tuple[IngestReport, str | None]], at: int, warnings: DataFrame | None = None) -> dict[str, list[str]]:
        """The run log with a run for each (report, error), and the warnings (source_object_id, warning) of these runs."""
        last = self._stored("ingest_runs").agg(F.max("id")).first()[0] or 0
        rows = [[last + n, r.source_object_id, r.mode, "failed" if error else "completed", at, at, r.seen, r.inserted, r.duplicates, r.deleted, r.warnings, error] for n, (r, error) in enumerate(reports, 1)]
        new = self._write("ingest_runs", self.spark.createDataFrame(rows, schema.struct(TABLES["ingest_runs"])).coalesce(1))
        tables = {"ingest_runs": [*self._parts("ingest_runs"), new]}
        if warnings is not None:
            # A row for each source of the commit; the warnings go from task to file.
            ids = self.spark.createDataFrame([(row[1], row[0]) for row in rows], "source_object_id string, run_id bigint")
            tables["ingest_warnings"] = [*self._parts("ingest_warnings"), self._write("ingest_warnings", warnings.join(F.broadcast(ids), "source_object_id"))]
        return tables

    def apply(self, source: str, records: DataFrame, mode: str, at: int, checkpoint: Checkpoint | None = None, warnings: Sequence[str] = ()) -> IngestReport:
        """Appends a batch to a source or replaces its events by it, with its checkpoint and run, in one commit.

        records: schema.RECORD rows, all of them the source's. A batch that the ledger refuses leaves a failed run and
        changes nothing else.
        """
        done = self.apply_all([Commit(source, mode, checkpoint or Checkpoint(), list(warnings))], records.withColumn("source_object_id", F.lit(source)), at)[source]
        if isinstance(done, Exception):
            raise done
        return done

    def apply_all(self, commits: Sequence[Commit], records: DataFrame, at: int, warnings: DataFrame | None = None) -> dict[str, IngestReport | IdentityConflict | InvalidRecord]:
        """apply() for several sources in one commit, whose jobs don't grow with their number.

        records: schema.RECORD rows of these sources, by source_object_id; rows of others are passed over. A source that
        the ledger refuses leaves a failed run and stays as it was, while the others go in; each source's report or error.
        warnings: (source_object_id, warning) rows for the run log, beside those of the commits; they are not in the reports.
        """
        if odd := [c.mode for c in commits if c.mode not in ("append", "replace")]:
            raise ValueError(odd[0])
        # A row for each source of the commit.
        wanted = self.spark.createDataFrame([(c.source,) for c in commits], "source_object_id string")
        batch = records.withColumn("provider", F.coalesce("provider", F.lit(""))).join(F.broadcast(wanted), "source_object_id", "left_semi")
        # Read by several jobs, each of which takes the columns it needs: a table, unless the records come from one.
        held = [] if getattr(records, "_settled_at", None) else [settled(batch, "commit-batch")]
        try:
            done, tables = self._prepared(commits, held[0] if held else batch)
        finally:
            forget(*held)
        good = [c for c in commits if isinstance(done[c.source], IngestReport)]
        if good:
            tables |= self._read_up_to(good, at)
        runs = [(r, None) if isinstance(r := done[c.source], IngestReport) else (IngestReport(c.source, c.mode, warnings=c.warnings), f"[ledger] {r}") for c in commits]
        if runs:
            waiting = sorted({*self._state().get("unpriced", []), *(c.source for c in good)})
            self._publish({**tables, **self._runs(runs, at, warnings)}, unpriced=waiting)
        return done

    def _read_up_to(self, commits: Sequence[Commit], at: int) -> dict:
        """The sources with their checkpoints, and their installations as readable ones."""
        objects, kinds = self.table("source_objects"), {f.name: f for f in schema.struct(TABLES["source_objects"]).fields}
        done = ("fingerprint", "parser_version", "byte_offset", "source_len", "prefix_fingerprint", "modified_ns", "parser_state")
        rows = [[c.source, *(getattr(c.checkpoint, k) for k in done)] for c in commits]
        kind = ", ".join(f"__{k} {kinds[k].dataType.simpleString()}" for k in ("id", *done))
        known = objects.join(F.broadcast(self.spark.createDataFrame(rows, kind)), F.col("id") == F.col("__id"), "left").persist()
        mine, values = F.col("__id").isNotNull(), {k: F.col(f"__{k}") for k in done}
        values |= {"last_scan_unix_ms": F.lit(at), "last_success_unix_ms": F.lit(at), "last_error": F.lit(None)}
        owners = known.filter(mine).select(F.col("installation_id").alias("id")).distinct().withColumn("__granted", F.lit(True))
        inst = self.table("source_installations").join(owners, "id", "left").withColumn("permission_state", F.when(F.col("__granted"), "granted").otherwise(F.col("permission_state")))
        out = {
            "source_objects": self._rewrite("source_objects", known.withColumns({k: F.when(mine, v).otherwise(F.col(k)) for k, v in values.items()})),
            "source_installations": self._rewrite("source_installations", inst),
        }
        known.unpersist()
        return out

    def append(self, source: str, records: DataFrame, at: int, **rest) -> IngestReport:
        return self.apply(source, records, "append", at, **rest)

    def replace(self, source: str, records: DataFrame, at: int, **rest) -> IngestReport:
        return self.apply(source, records, "replace", at, **rest)

    def _prepared(self, commits: Sequence[Commit], batch: DataFrame) -> tuple[dict, dict]:
        """Each source's report or error, and the tables with the events of the sources that are in order."""
        batch = batch.withColumn("__costs", F.array_sort(F.transform("costs", lambda c: F.struct(c.kind, c.usd_nanos, c.confidence))))
        facts = [*schema.FACTS, "__costs"]
        done: dict = {}
        month = F.substring(timeutil.day(F.col("occurred_at_unix_ms")).cast("string"), 1, 7)
        each = batch.withColumns({"__problem": problem_of(), "__month": month}).groupBy(*KEY)
        events = each.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.to_json(F.struct(*facts))).alias("versions"), F.min("__problem").alias("problem"), F.collect_set("__month").alias("months"))
        odd, bad = F.min(F.when(F.col("versions") > 1, F.struct("event_id"))), F.min(F.when(F.col("problem").isNotNull(), F.struct("event_id", "problem")))
        told = events.groupBy("source_object_id").agg(F.sum("n").alias("seen"), F.count(F.lit(1)).alias("events"), odd.alias("odd"), bad.alias("bad"), F.array_distinct(F.flatten(F.collect_set("months"))).alias("months"))
        tally = {r["source_object_id"]: r for r in told.collect()}  # a row for each source of the commit, at most; so with all that follows
        for source, r in tally.items():
            if r["bad"] is not None:
                done[source] = InvalidRecord(f"{r['bad']['event_id']}: {r['bad']['problem']}")
            elif r["odd"] is not None:
                done[source] = IdentityConflict(f"{r['odd']['event_id']} has several facts in one batch")
        once, held = batch.dropDuplicates(KEY), self._parts("usage_events")
        again = [c.source for c in commits if c.mode == "append" and held.get(c.source) and c.source in tally and c.source not in done]
        known: dict[str, int] = {}
        if again:
            stored = self.records(*again)
            both = compare_again(stored, once, facts).groupBy("source_object_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("conflict"), F.struct("event_id"))).alias("clash"))
            for r in both.collect():
                known[r["source_object_id"]] = r["n"]
                if r["clash"] is not None:
                    done[r["source_object_id"]] = IdentityConflict(f"{r['clash']['event_id']} is stored with other facts")
            once = once.join(stored.select(*KEY).hint("merge"), KEY, "left_anti")
        replaced = [c.source for c in commits if c.mode == "replace" and held.get(c.source) and c.source not in done]
        gone = self.owned("usage_events", *replaced).groupBy("source_object_id").agg(F.count(F.lit(1)).alias("n"), F.collect_set(month).alias("months")).collect() if replaced else []
        deleted = {r["source_object_id"]: r["n"] for r in gone}
        if done:
            refused = self.spark.createDataFrame([(s,) for s in done], "source_object_id string")
            once = once.join(F.broadcast(refused), "source_object_id", "left_anti")
        changed: dict[str, int] = {}
        for c in commits:
            if c.source not in done:
                r = tally.get(c.source)
                seen, new = (r["seen"], r["events"] - known.get(c.source, 0)) if r else (0, 0)
                done[c.source], changed[c.source] = IngestReport(c.source, c.mode, seen, new, seen - new, deleted.get(c.source, 0), c.warnings), new
        if not any(changed.values()) and not replaced:
            return done, {}
        # A table and no cache: what reads a cache keeps the partitions of the shuffle before it, however small they are.
        once = settled(once, "commit-events")
        costs = once.select(*KEY, F.explode("costs").alias("c")).select(*KEY, "c.kind", "c.usd_nanos", "c.confidence")
        costs = costs.withColumns({x: F.lit(None) for x in ("pricing_snapshot_id", "pricing_key", "pricing_rule")})
        tables = {}
        for name, df in {"usage_events": once, "event_provenance": once, "event_costs": costs}.items():
            parts, new = dict(self._parts(name)), {s for s, n in changed.items() if n}
            made = self._added(self._write(name, df), new) if new else {}
            for c in commits:
                if c.source in changed:
                    # An empty replacement clears the source: it then has no folder.
                    parts[c.source] = [*(parts.get(c.source, []) if c.mode == "append" else []), *([made[c.source]] if c.source in made else [])]
            tables[name] = parts
        months = {m for s, n in changed.items() if n for m in tally[s]["months"]} | {m for r in gone if r["source_object_id"] in changed for m in r["months"]}
        tables |= self._projected([c for c in commits if c.source in changed], once, replaced, sorted(months))
        forget(once)
        return done, tables

    # -- projections, kept by each commit

    def _projected(self, commits: Sequence[Commit], once: DataFrame, replaced: Sequence[str], months: Sequence[str]) -> dict:
        """The daily projection and the sessions after a commit that adds `once` and deletes what `replaced` had, in these months.

        A day's sums change by what is new less what is gone, and only the months that have such a change are written. A
        session's ends can't be subtracted: they are kept by source, where a replacement makes them anew, and an append
        adds those of its own events.
        """
        tables = {}
        if months:
            gone = Q.daily_usage(self.owned("usage_events", *replaced))
            less = gone.select("day", "client", "provider", "model", *((-F.col(c)).alias(c) for c in [*schema.BUCKETS, "event_count"]))
            days = Q.merge_daily(self.owned("daily_usage_utc", *months).drop("month").unionByName(less), Q.daily_usage(once)).filter("event_count > 0")
            made = self._added(self._write("daily_usage_utc", days.withColumn("month", F.substring("day", 1, 7))), months)
            tables["daily_usage_utc"] = dict(self._parts("daily_usage_utc")) | {m: [made[m]] if m in made else [] for m in months}
        parts, fresh = dict(self._parts("session_parts")), {c.source for c in commits if c.mode == "replace"}
        crowded = [c.source for c in commits if c.source not in fresh and len(parts.get(c.source, [])) >= MOST_PARTS]
        mine = Q.session_parts(once)
        if crowded:
            mine = Q.merged_sessions(self.owned("session_parts", *crowded).unionByName(mine))
        made = self._added(self._write("session_parts", mine), [c.source for c in commits])
        for c in commits:
            kept = [] if c.source in fresh or c.source in crowded else parts.get(c.source, [])
            parts[c.source] = [*kept, *([made[c.source]] if c.source in made else [])]
        return tables | {"session_parts": parts}

    def daily(self) -> DataFrame:
        """The daily projection, as Q.daily_usage() of all events would give it."""
        return self.table("daily_usage_utc").drop("month")

    def sessions(self) -> DataFrame:
        """(source, session) with its first and last event, as Q.session_spans() of all events would give it."""
        out = Q.merged_sessions(self.table("session_parts"))
        return out.select("source_object_id", "session_id", F.col("started_unix_ms").alias("started_at_unix_ms"), F.col("ended_unix_ms").alias("ended_at_unix_ms"), "client")

    def rebuild_projections(self) -> None:
        """Makes both projections anew from the events (for ledgers that were written before they were kept)."""
        events, tables = self.table("usage_events"), {}
        for name, df in {"daily_usage_utc": Q.daily_usage(events).withColumn("month", F.substring("day", 1, 7)), "session_parts": Q.session_parts(events)}.items():
            df = settled(df, "rebuilt")
            keys = [r[0] for r in df.select(OWNED[name]).distinct().collect()]  # a row a part
            path = self._write(name, df) if keys else ""
            tables[name] = {k: [f"{path}/{part_of(k)}"] for k in keys}
            forget(df)
        self._publish(tables)

    def records(self, *sources: str) -> DataFrame:
        """Some sources' events with provenance and the costs that the sources themselves reported."""
        costs = self.owned("event_costs", *sources).filter(~F.col("kind").isin(ESTIMATE, UNPRICED))
        costs = costs.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("kind", "usd_nanos", "confidence"))).alias("__costs"))
        out = self.owned("usage_events", *sources).join(self.owned("event_provenance", *sources).hint("merge"), KEY, "left").join(costs.hint("merge"), KEY, "left")
        return out.withColumn("__costs", F.coalesce("__costs", F.array().cast("array<struct<kind:string,usd_nanos:bigint,confidence:string>>")))

    def fail(self, source: str, at: int, kind: str, message: str) -> None:
        """Records that a source could not be read; its events stay. kind permission_denied marks the installation, too."""
        self.fail_all([(source, kind, message)], at)

    def fail_all(self, failures: Sequence[tuple[str, str, str]], at: int) -> None:
        """fail() for several (source, kind, message) in one commit."""
        if not failures:
            return
        said = self.spark.createDataFrame([(s, f"[{kind}] {message}", kind) for s, kind, message in failures], "__id string, __error string, __kind string")
        objects = self.table("source_objects").join(F.broadcast(said), F.col("id") == F.col("__id"), "left")
        mine = F.col("__id").isNotNull()
        tables = {"source_objects": self._rewrite("source_objects", objects.withColumns({"last_error": F.when(mine, F.col("__error")).otherwise(F.col("last_error")), "last_scan_unix_ms": F.when(mine, F.lit(at)).otherwise(F.col("last_scan_unix_ms"))}))}
        if any(kind == "permission_denied" for _, kind, _ in failures):
            owners = objects.filter(F.col("__kind") == "permission_denied").select(F.col("installation_id").alias("id")).distinct().withColumn("__denied", F.lit(True))
            inst = self.table("source_installations").join(owners, "id", "left")
            tables["source_installations"] = self._rewrite("source_installations", inst.withColumn("permission_state", F.when(F.col("__denied"), "denied").otherwise(F.col("permission_state"))))
        self._publish({**tables, **self._runs([(IngestReport(s, "append"), f"[{kind}] {message}") for s, kind, message in failures], at)})

    # -- pricing

    def record_snapshot(self, dataset: pricing.RateDataset, at: int) -> int:
        """The id of a dataset's snapshot; one that is known keeps the time it was first fetched."""
        rows, key = self.table("pricing_snapshots"), (dataset.source, dataset.version, dataset.content_hash())
        known = rows.filter((F.col("source") == key[0]) & (F.col("dataset_version") == key[1]) & (F.col("content_hash") == key[2])).first()
        if known:
            return known["id"]
        id = (rows.agg(F.max("id")).first()[0] or 0) + 1
        new = self.spark.createDataFrame([[id, *key, at]], schema.struct(TABLES["pricing_snapshots"]))
        self._publish({"pricing_snapshots": self._rewrite("pricing_snapshots", rows.unionByName(new))})
        return id

    def reprice(self, dataset: pricing.RateDataset, at: int) -> dict[str, int]:
        """Estimates every event anew; the costs that sources reported stay as they are."""
        return self._priced(dataset, self.record_snapshot(dataset, at), list(self._parts("usage_events")))

    def price_changed(self, dataset: pricing.RateDataset, at: int) -> dict[str, int]:
        """Estimates the events of the sources that changed since the last pricing, if that was by the same dataset; else all."""
        snapshot, state = self.record_snapshot(dataset, at), self._state()
        return self._priced(dataset, snapshot, state.get("unpriced", []) if state.get("priced_by") == snapshot else list(self._parts("usage_events")))

    def _priced(self, dataset: pricing.RateDataset, snapshot: int, sources: Sequence[str]) -> dict[str, int]:
        facts = pricing.estimate_facts(self.owned("usage_events", *sources), dataset, snapshot)
        costs = settled(pricing.replace_estimates(self.owned("event_costs", *sources), facts), "priced")
        counters = pricing.reprice_counters(costs).first().asDict()
        made = self._added(self._write("event_costs", costs), sources) if sources else {}
        forget(costs)
        parts = self._parts("event_costs") | {source: [made[source]] if source in made else [] for source in sources}
        self._publish({"event_costs": parts}, priced_by=snapshot, unpriced=[])
        return counters
