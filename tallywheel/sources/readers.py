"""Readers of usage journals. Each discovers files and turns all of them into records with one declarative plan.

Records are schema.RECORD rows whose source_object_id is the source key. What a reader leaves out, or had to guess, it
says in a warning.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallywheel.functions import identity, timeutil
from tallywheel.functions.money import U64_MAX, parse_nanos
from tallywheel.operators import sequences
from tallywheel.schema import BUCKETS, RECORD, struct
from tallywheel.sources.lines import Batch, Candidate, collected, files_under, raw_lines, read_lines, whole_files
from tallywheel.tables import settled

FIELDS = [part.split(" ")[0] for part in RECORD.split(", ")]


def _json(column: str, ddl: str) -> Column:
    """A JSON object as a struct; null where it doesn't fit (numbers with a point for integers, say) or isn't an object."""
    return F.from_json(F.when(F.col(column).rlike(r"^\s*\{"), F.col(column)), f"{ddl}, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})


def _records(rows: DataFrame, **values) -> DataFrame:
    """RECORD rows from named expressions; fields that aren't named are null."""
    base = {"source_object_id": F.col("source_key"), "record_offset": F.col("record_offset") if "record_offset" in rows.columns else F.lit(None), "costs": F.array()} | values
    kinds = {f.name: f.dataType for f in struct(RECORD).fields}
    return rows.select(*(base.get(name, F.lit(None)).cast(kinds[name]).alias(name) for name in FIELDS))


def _sum(*parts: Column) -> Column:
    return sum((p.cast("decimal(21,0)") for p in parts[1:]), parts[0].cast("decimal(21,0)"))


def _note(when: Column, text: Column | str) -> Column:
    return F.when(when, text if isinstance(text, Column) else F.lit(text))


def _notes(*notes) -> Column:
    cols = [F.lit(n) if isinstance(n, str) else n for n in notes]
    return F.filter(F.array(*cols), lambda n: n.isNotNull())


def _place(root, path) -> str:
    """A file's path below its folder."""
    return str(path)[len(str(root).rstrip("/")) + 1 :]


def _under(root, *parts: str):
    return "/".join([str(root).rstrip("/"), *parts]) if "://" in str(root) else Path(root, *parts)


def _home_of(root):
    """A reader's folder or file: a local path, or a URI as it is."""
    return root if "://" in str(root) else Path(root)


def _seeded(rows: DataFrame, states: dict[str, str] | None, kind: str) -> DataFrame:
    """rows with __s: what their source's last reading left, null for a source that is read from its start."""
    if not states:
        return rows.withColumn("__s", F.lit(None).cast(kind))
    known = rows.sparkSession.createDataFrame(list(states.items()), "source_key string, __text string")
    return rows.join(F.broadcast(known), "source_key", "left").withColumn("__s", F.from_json("__text", kind)).drop("__text")


def _begins(offsets: dict[str, int] | None, states: dict[str, str] | None) -> dict[str, int]:
    """Where reading may begin: at a source's offset, if what its reader has to know is known, too."""
    return {k: at for k, at in (offsets or {}).items() if k in (states or {})}


class Reader:
    """The contract of a format: an id, a version of its parser, discovery and reading."""

    id = ""
    parser_version = 1
    resumable = True
    kinds: tuple[str, ...] = ("append_only_jsonl",)  # of files that it reads

    def discover(self, spark: SparkSession | None = None) -> list[Candidate]:
        """The files of this format. A reader that must look into them does so in a Spark job, where a session is given."""
        raise NotImplementedError

    def read(self, spark: SparkSession, candidates: Sequence[Candidate], offsets: dict[str, int] | None = None, states: dict[str, str] | None = None) -> Batch:
        """The batch of the candidates. offsets: bytes of each that are in the ledger already; only what follows becomes records.

        states: what an earlier batch left (Batch.states) where those bytes end. A source that has its state is read from
        there; a reader with memory reads a source without one whole, and keeps what is new.
        """
        raise NotImplementedError

    @staticmethod
    def default_roots(env: dict[str, str] | None = None) -> list[Path]:
        return []


def _at(when: Column, text: str) -> Column:
    """A warning about the line at a row's place, where `when` holds."""
    return F.when(when, F.format_string(f"byte %d: {text}", "record_offset"))


def _states(ends: DataFrame, left: DataFrame, states: dict[str, str] | None, state: Column) -> DataFrame:
    """(source_key, state): what a reading leaves as JSON, by source; a source of which no line was read keeps what it had."""
    before = ends.sparkSession.createDataFrame(list((states or {}).items()), "source_key string, __was string")
    told = left.select("source_key", F.to_json(state).alias("__now"))
    return ends.select("source_key").join(told, "source_key", "left").join(F.broadcast(before), "source_key", "left").select("source_key", F.coalesce("__now", "__was", F.lit("{}")).alias("state"))


def _home(env) -> Path:
    return Path(env.get("HOME") or os.path.expanduser("~"))


def _expanded(value: str, env) -> Path:
    return _home(env) / value[2:] if value.startswith("~/") else _home(env) if value == "~" else Path(value)


def _since(rows: DataFrame, offsets: dict[str, int] | None) -> DataFrame:
    """The rows from each source's offset on (readers with memory read the whole file, and keep what is new)."""
    if not offsets:
        return rows
    begin = rows.sparkSession.createDataFrame(list(offsets.items()), "source_key string, __begin bigint")
    return rows.join(F.broadcast(begin), "source_key", "left").filter(F.col("record_offset") >= F.coalesce("__begin", F.lit(0))).drop("__begin")


# -- the ledger's own format

EVENT = "id string, session_id string, client string, provider string, model string, occurred_at_unix_ms bigint, input bigint, output bigint, cache_read bigint, cache_write bigint, reasoning bigint, source_reported_total bigint"
EVENT_FIELDS = [x.split()[0] for x in EVENT.split(", ")]


def _own_records(rows: DataFrame) -> DataFrame:
    counts = {f"{x}_tokens": F.coalesce(F.col(f"e.{x}"), F.lit(0)) for x in ("input", "output", "cache_read", "cache_write", "reasoning")}
    plain = {x: F.col(f"e.{x}") for x in ("session_id", "client", "provider", "model", "occurred_at_unix_ms", "source_reported_total")}
    return _records(rows, event_id=F.col("e.id"), native_id=F.col("e.id"), **plain, **counts, confidence=F.lit("exact"), schema_variant=F.lit("reference-v1"), timestamp_origin=F.lit("source"), normalization_notes=F.array())


def _strict(text: Column) -> Column:
    """Whether an object has known fields only, with all that are required."""
    keys = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    known = F.size(F.array_except(keys, F.array(*(F.lit(f) for f in EVENT_FIELDS)))) == 0
    counts = [F.coalesce(F.col(f"e.{c}") >= 0, F.lit(True)) for c in ("input", "output", "cache_read", "cache_write", "reasoning", "source_reported_total")]
    for c in ("id", "client", "model", "occurred_at_unix_ms"):
        counts.append(F.col(f"e.{c}").isNotNull())
    out = known & F.col("e").isNotNull() & F.col("e.__bad").isNull()
    for c in counts:
        out = out & c
    return F.coalesce(out, F.lit(False))


class _LineFiles(Reader):
    """A file of lines, or a folder of such files: a line needs nothing but itself."""

    def __init__(self, path):
        self.path = _home_of(path)

    def discover(self, spark=None):
        if "://" not in str(self.path) and self.path.is_file():
            return [Candidate(self.path.name, str(self.path))]
        return [Candidate(_place(self.path, p), str(p)) for p in files_under(self.path, "*.jsonl")]


class EventLines(_LineFiles):
    """One event a line, strict: an unknown field makes a line malformed."""

    id = "reference-jsonl"

    def read(self, spark, candidates, offsets=None, states=None):
        kept = []
        lines, warnings, ends = read_lines(spark, candidates, offsets, kept)
        rows = lines.withColumn("e", _json("line", EVENT)).withColumn("ok", _strict(F.col("line")))
        return Batch(_own_records(rows.filter("ok")), warnings.unionByName(collected(rows.withColumn("says", F.array(_at(~F.col("ok"), "this line is no event and was passed over"))), "says")), ends, kept=kept)


class EventSnapshot(Reader):
    """One document with all events; reading it replaces what it said before."""

    id = "reference-snapshot"
    kinds = ("mutable_json",)
    resumable = False

    def __init__(self, path):
        self.path = Path(path)

    def discover(self, spark=None):
        return [Candidate(self.path.name, str(self.path), "mutable_json")] if self.path.is_file() else []

    def read(self, spark, candidates, offsets=None, states=None):
        docs = whole_files(spark, candidates).withColumn("d", F.from_json("text", "events array<string>"))
        rows = docs.select("source_key", "modified_unix_ms", F.col("d.events").isNull().alias("bad"), F.explode_outer("d.events").alias("line"))
        rows = rows.withColumn("e", _json("line", EVENT)).withColumn("ok", _strict(F.col("line")) & ~F.col("bad"))
        broken = rows.filter("bad OR (line IS NOT NULL AND NOT ok)").select("source_key", F.lit("[schema] the document is no event snapshot").alias("warning")).distinct()
        # One event that doesn't fit fails the document: its source keeps what it had.
        good = rows.filter("ok").join(broken.select("source_key"), "source_key", "left_anti")
        return Batch(_own_records(good), broken)


# -- wire journals

_SNAKE = "struct<input_other:bigint,output:bigint,input_cache_read:bigint,input_cache_creation:bigint>"
_CAMEL = "struct<inputOther:bigint,output:bigint,inputCacheRead:bigint,inputCacheCreation:bigint>"
_WIRE = f"timestamp double, message struct<type:string,payload:struct<token_usage:{_SNAKE},message_id:string>>, type string, time bigint, model string, usage {_CAMEL}, usageScope string"


class WireJournals(Reader):
    """wire.jsonl files in two layouts: status updates with a message id, and flat usage records."""

    id = "kimi-wire"
    parser_version = 2

    def __init__(self, root):
        self.root = _home_of(root)

    @staticmethod
    def default_roots(env=None):
        env = os.environ if env is None else env
        code = _expanded(env["KIMI_CODE_HOME"], env) if env.get("KIMI_CODE_HOME") else _home(env) / ".kimi-code"
        share = _expanded(env["KIMI_SHARE_DIR"], env) if env.get("KIMI_SHARE_DIR") else _home(env) / ".kimi"
        return [code, share]

    def discover(self, spark=None):
        return [Candidate(_place(self.root, p), str(p)) for p in files_under(_under(self.root, "sessions"), "wire.jsonl")]

    def read(self, spark, candidates, offsets=None, states=None):
        """State: the model that was last requested."""
        kept = []
        lines, warnings, ends = read_lines(spark, candidates, _begins(offsets, states), kept)
        rows = lines.withColumn("w", _json("line", _WIRE)).withColumn("session_id", identity.session_of_path(F.col("path")))
        old = F.col("w.message.type").isNotNull() & F.col("w.timestamp").isNotNull()
        kind = F.when(old, F.col("w.message.type")).otherwise(F.col("w.type"))
        u, v = F.col("w.usage"), F.col("w.message.payload.token_usage")
        zero = lambda c: F.coalesce(c, F.lit(0))
        pairs = (("input_tokens", "inputOther", "input_other"), ("output_tokens", "output", "output"), ("cache_read_tokens", "inputCacheRead", "input_cache_read"), ("cache_write_tokens", "inputCacheCreation", "input_cache_creation"))
        rows = rows.withColumns({"old": old, "kind": kind, **{b: zero(F.when(old, v[s]).otherwise(u[c])) for b, c, s in pairs}})
        negative = F.least(*(b for b, _, _ in pairs)) < 0
        rows = rows.withColumn("ok", F.coalesce(F.col("w").isNotNull() & F.col("w.__bad").isNull() & F.col("kind").isNotNull() & ~negative, F.lit(False)))
        rows = rows.withColumn("named", F.when(F.col("ok") & ~F.col("old") & (F.col("kind") == "llm.request"), identity.plain_model(F.col("w.model"))))
        rows = _seeded(sequences.carried(rows, ["source_key"], "record_offset", {"last_model": "named"}), states, "struct<last_model:string>")
        rows = rows.withColumns({"last_model": F.coalesce("last_model", "__s.last_model"), "total": _sum(*(F.col(b) for b, _, _ in pairs))})
        update, usage = F.col("old") & (F.col("kind") == "StatusUpdate") & v.isNotNull(), ~F.col("old") & (F.col("kind") == "usage.record")
        rows = rows.withColumns({"update": update, "flat": usage & u.isNotNull(), "says": F.array(
            _at(~F.col("ok"), "this line is no wire record and was passed over"),
            _at(F.col("ok") & usage & u.isNull(), "a usage record without its counts was passed over"),
            _at(F.col("ok") & ((usage & u.isNotNull()) | update) & (F.col("total") == 0), "usage with nothing counted was passed over"),
        )})
        rows = settled(rows, "wire", kept)
        left = rows.groupBy("source_key").agg(F.max_by("last_model", "record_offset").alias("last_model"))
        after = _states(ends, left, states, F.struct("last_model"))
        rows = _since(rows, offsets)
        warnings = warnings.unionByName(collected(rows, "says"))
        rows = rows.filter("ok AND (update OR flat)").filter((F.col("total") > 0) & (F.col("total") <= F.lit(str(U64_MAX)).cast("decimal(20,0)")))
        raw, scope = F.coalesce("w.model", F.lit("")), F.coalesce("w.usageScope", F.lit("turn"))
        own = identity.plain_model(raw)
        native = F.when(F.col("old"), F.nullif("w.message.payload.message_id", F.lit("")))
        seconds = timeutil.seconds_millis(F.col("w.timestamp"))
        given = F.when(F.col("old"), seconds).otherwise(F.when(F.col("w.time") > 0, F.col("w.time")))
        counts = [F.col(b) for b, _, _ in pairs]
        old_id = F.when(native.isNotNull(), identity.sha256_of("kimi-wire-v1", native)).otherwise(identity.sha256_of("kimi-wire-fp1", F.col("source_key"), *counts, F.col("w.timestamp")))
        new_id = identity.sha256_of("kimi-wire-fp2", F.col("source_key"), zero(F.col("w.time")), raw, *counts, scope)
        notes = _notes(
            _note(~F.col("old") & own.isNull() & F.col("last_model").isNotNull(), F.concat(F.lit("the record named the placeholder model '"), raw, F.lit("'; the last model requested was used"))),
            _note(~F.col("old") & own.isNull() & F.col("last_model").isNull(), F.concat(F.lit("the record named the placeholder model '"), raw, F.lit("' before any model was requested"))),
            _note(given.isNull(), "no usable time; the file's time was used"),
            "reasoning is part of output in this format",
            _note(F.col("old"), "this layout names no model"),
            _note(~F.col("old"), F.concat(F.lit("usage scope: "), scope)),
        )
        records = _records(
            rows, event_id=F.when(F.col("old"), F.concat(F.lit("kimi-wire-v1:"), old_id)).otherwise(F.concat(F.lit("kimi-wire-v2:"), new_id)), session_id=F.col("session_id"), client=F.lit("kimi-code"),
            model=F.when(F.col("old"), "unknown").otherwise(F.coalesce(own, "last_model", F.lit("unknown"))), occurred_at_unix_ms=F.coalesce(given, "modified_unix_ms"), **{b: F.col(b) for b, _, _ in pairs}, reasoning_tokens=F.lit(0),
            confidence=F.lit("exact"), native_id=native, schema_variant=F.when(F.col("old"), "kimi-wire-v1-status-update").otherwise("kimi-wire-v2-usage-record"), timestamp_origin=F.when(given.isNull(), "file_modified").otherwise("source"), normalization_notes=notes,
        )
        # A message id or flat identity that comes again: the largest total wins, at the first one's place.
        total = _sum(*(F.col(b) for b in BUCKETS))
        by = W.partitionBy("source_object_id", "event_id")
        records = records.withColumns({"__total": total, "__first": F.min("record_offset").over(by), "__n": F.count(F.lit(1)).over(by)})
        again = records.filter("__n > 1 AND native_id IS NOT NULL").select(F.col("source_object_id").alias("source_key"), F.format_string("of several reports of message %s, the one that counts most was taken", "native_id").alias("warning")).distinct()
        best = F.row_number().over(by.orderBy(F.desc("__total"), "record_offset"))
        records = records.withColumn("__r", best).filter("__r = 1").withColumn("record_offset", F.col("__first"))
        return Batch(records.select(*FIELDS), warnings.unionByName(again), ends, after, kept)


# -- session trees

_P_COST = "struct<input:string,output:string,cacheRead:string,cacheWrite:string,total:string>"
_P_USAGE = f"struct<input:bigint,output:bigint,cacheRead:bigint,cacheWrite:bigint,cacheWrite1h:bigint,reasoning:bigint,totalTokens:bigint,cost:{_P_COST}>"
_PI = f"type string, version bigint, id string, timestamp string, parentSession string, message struct<role:string,provider:string,model:string,responseModel:string,timestamp:bigint,usage:{_P_USAGE}>, usage {_P_USAGE}"


_PI_STATE = "struct<h:struct<version:bigint,id:string,parent:string>,heads:bigint,doubt:boolean>"
_SIGNED = "kind", "u", "provider", "model", "timestamp"


class SessionTrees(Reader):
    """Session files with a header each; a child session repeats entries of the one it was forked from."""

    id = "pi-jsonl"

    def __init__(self, root):
        self.root = _home_of(root)

    @staticmethod
    def default_roots(env=None):
        env = os.environ if env is None else env
        if env.get("PI_CODING_AGENT_SESSION_DIR"):
            return [_expanded(env["PI_CODING_AGENT_SESSION_DIR"], env)]
        if env.get("PI_CODING_AGENT_DIR"):
            return [_expanded(env["PI_CODING_AGENT_DIR"], env) / "sessions"]
        return [_home(env) / ".pi" / "agent" / "sessions"]

    def discover(self, spark=None):
        files = [str(p) for p in files_under(self.root, "*.jsonl")]
        if not files:
            return []
        # A file's key is its header's: the first line that isn't blank. A session's absence means a few files, by hand.
        if spark is not None:
            raw, _ = raw_lines(spark, [Candidate(p, p) for p in files], most=1 << 16)
            first = raw.filter(F.trim(F.col("line").cast("string")) != "").groupBy("source_key").agg(F.min_by(F.col("line").cast("string"), "record_offset").alias("line"))
            head = F.from_json("line", "type string, id string")
            ids = {r[0]: r[1] for r in first.filter((head["type"] == "session") & (head["id"] != "")).select("source_key", head["id"]).collect()}  # a row a file
        else:
            ids = {p: i for p in files if (i := _header_id(p))}
        names = {p: p.rsplit("/", 1)[-1] for p in files}
        return sorted((Candidate(f"session:{ids[p]}:{names[p]}" if p in ids else names[p], p) for p in files), key=lambda c: c.source_key)

    @staticmethod
    def _parsed(lines: DataFrame) -> DataFrame:
        rows = lines.withColumn("p", _json("line", _PI)).withColumn("file", F.element_at(F.split("path", "/"), -1))
        rows = rows.withColumn("ok", F.coalesce(F.col("p").isNotNull() & F.col("p.__bad").isNull() & F.col("p.type").isNotNull(), F.lit(False)))
        message = F.col("p.type") == "message"
        u = F.when(message & (F.col("p.message.role") == "assistant"), F.col("p.message.usage")).when(F.col("p.type").isin("compaction", "branch_summary"), F.col("p.usage"))
        head = F.when(F.col("p.type") == "session", F.struct(F.coalesce("p.version", F.lit(1)).cast("bigint").alias("version"), F.nullif("p.id", F.lit("")).alias("id"), F.col("p.parentSession").alias("parent")))
        signature = F.struct(F.col("p.type").alias("kind"), u.alias("u"), F.col("p.message.provider").alias("provider"), F.coalesce("p.message.responseModel", "p.message.model").alias("model"), F.col("p.message.timestamp").alias("timestamp"))
        return rows.withColumns({"head": F.when(F.col("ok"), head), "u": F.when(F.col("ok"), u), "native": F.nullif("p.id", F.lit("")), "signature": signature})

    def read(self, spark, candidates, offsets=None, states=None):
        """State: the header, how many there were, and whether the lineage is in doubt. Of other files, parents only are read."""
        kept = []
        begins = _begins(offsets, states)
        lines, warnings, ends = read_lines(spark, candidates, begins, kept)
        rows = _seeded(self._parsed(lines), states, _PI_STATE)
        w = W.partitionBy("source_key").orderBy("record_offset").rowsBetween(W.unboundedPreceding, 0)
        rows = rows.withColumns({"h": F.coalesce(F.col("__s.h"), F.first("head", ignorenulls=True).over(w)), "heads": F.coalesce(F.col("__s.heads"), F.lit(0)) + F.count("head").over(w)})
        rows = rows.withColumn("parent_file", F.element_at(F.split("h.parent", "[/\\\\]"), -1)).drop("line")
        rows = settled(rows, "sessions", kept)
        # The parent is a file of this name; what a child repeats unchanged from it is the parent's.
        parents = rows.filter("parent_file IS NOT NULL").select(F.col("parent_file").alias("file")).distinct()
        have = {c.path.rsplit("/", 1)[-1] for c in candidates if not begins.get(c.source_key)}
        wanted = {r[0] for r in parents.collect()} - have  # of these candidates, at most
        others = [Candidate(str(p), str(p)) for p in files_under(self.root, "*.jsonl") if str(p).rsplit("/", 1)[-1] in wanted] if wanted else []
        family = rows.select("file", "record_offset", "ok", "head", "u", "native", "signature").join(parents, "file", "left_semi")
        if begins:
            family = family.join(spark.createDataFrame([(name,) for name in sorted(have)], "file string"), "file", "left_semi")
        if others:
            family = family.unionByName(self._parsed(read_lines(spark, others, kept=kept)[0]).select("file", "record_offset", "ok", "head", "u", "native", "signature"))
        theirs = family.filter("u IS NOT NULL AND head IS NULL AND native IS NOT NULL").groupBy(F.col("file").alias("parent_file"), "native").agg(F.max_by("signature", "record_offset").alias("theirs"))
        known = family.groupBy(F.col("file").alias("parent_file")).agg(F.max("ok").alias("known"), F.max(~F.col("ok")).alias("broken")).filter("known")
        message = F.col("p.type") == "message"
        usable = F.coalesce((F.col("h.version") <= 3) & F.col("h.id").isNotNull(), F.lit(False))
        first = (F.col("heads") == 1) & F.col("head").isNotNull()
        is_usage = F.col("u").isNotNull() & F.col("head").isNull()
        fresh = _since(rows, offsets)
        says = F.array(
            _at(~F.col("ok"), "this line is no session record and was passed over"),
            _at(F.col("head").isNotNull() & (F.col("heads") > 1), "another header in the same session was passed over"),
            _at(first & (F.col("h.version") > 3), "the session's format is newer than version 3; its usage was left out"),
            _at(first & (F.col("h.version") <= 3) & F.col("h.id").isNull(), "the session's header names no id; its usage was left out"),
            _at(is_usage & ~usable, "usage that no readable header precedes was left out"),
        )
        warnings = warnings.unionByName(collected(fresh.withColumn("says", says), "says"))
        model = F.coalesce(F.nullif("p.message.responseModel", F.lit("")), F.nullif("p.message.model", F.lit("")))
        # Sessions without a parent stay out of the joins, whose null keys would meet in one task.
        usage, kinds = rows.filter(is_usage & usable), dict(theirs.dtypes)
        alone = usage.filter("parent_file IS NULL").withColumns({"known": F.lit(None).cast("boolean"), "broken": F.lit(None).cast("boolean"), "theirs": F.lit(None).cast(kinds["theirs"])})
        child = usage.filter("parent_file IS NOT NULL").join(known, "parent_file", "left").join(theirs, ["parent_file", "native"], "left").unionByName(alone)
        lost = F.col("h.parent").isNotNull() & (F.col("known").isNull() | F.coalesce("broken", F.lit(False)))
        resolved = F.col("theirs").isNotNull() & ~lost
        child = child.withColumns({"lost": lost, "kept": ~(resolved & F.col("signature").eqNullSafe(F.col("theirs"))), "changed": resolved & ~F.col("signature").eqNullSafe(F.col("theirs"))})
        # From the first changed entry on the lineage is in doubt.
        so_far = W.partitionBy("source_key").orderBy("record_offset").rowsBetween(W.unboundedPreceding, 0)
        child = child.withColumn("doubt", F.coalesce(F.col("__s.doubt"), F.lit(False)) | F.max(F.col("changed") | F.col("lost")).over(so_far))
        child = settled(child.drop("theirs", "broken", "known"), "session-usage", kept)
        left = rows.groupBy("source_key").agg(F.max_by(F.struct("h", "heads"), "record_offset").alias("x"), F.max(F.coalesce(F.col("__s.doubt"), F.lit(False))).alias("was"))
        left = left.join(child.groupBy("source_key").agg(F.max("doubt").alias("now")), "source_key", "left")
        after = _states(ends, left, states, F.struct(F.col("x.h").alias("h"), F.col("x.heads").alias("heads"), (F.col("was") | F.coalesce("now", F.lit(False))).alias("doubt")))
        child = _since(child, offsets)
        warnings = warnings.unionByName(child.filter("lost").select("source_key", F.lit("the session this one was forked from can't be read; entries that may be its own were kept").alias("warning")).distinct())
        child = child.filter("kept")
        names = {"input": "input", "output": "output", "cacheRead": "cache reads", "cacheWrite": "cache writes", "cacheWrite1h": "hour-long cache writes", "reasoning": "reasoning"}
        n = {k: F.greatest(F.coalesce(F.col("u")[k], F.lit(0)), F.lit(0)) for k in names}
        below = {k: F.coalesce(F.col("u")[k] < 0, F.lit(False)) for k in names}
        child = child.withColumns({"input_tokens": n["input"], "output_tokens": F.greatest(n["output"] - n["reasoning"], F.lit(0)), "cache_read_tokens": n["cacheRead"], "cache_write_tokens": n["cacheWrite"], "reasoning_tokens": n["reasoning"]})
        total = _sum(*(F.col(b) for b in BUCKETS))
        told = F.when(F.col("u.totalTokens") > 0, F.col("u.totalTokens"))
        parts = {k: parse_nanos(F.col("u.cost")[k]) for k in ("input", "output", "cacheRead", "cacheWrite")}
        has = {k: F.col("u.cost")[k].isNotNull() for k in parts}
        valid = ~(sum((F.when(has[k] & parts[k]["error"].isNotNull(), 1).otherwise(0) for k in parts), F.lit(0)) > 0)
        some = sum((F.when(has[k], 1).otherwise(0) for k in parts), F.lit(0)) > 0
        added = sum((F.coalesce(parts[k]["nanos"], F.lit(0).cast("decimal(20,0)")) for k in parts), F.lit(0).cast("decimal(20,0)"))
        whole = parse_nanos(F.col("u.cost.total"))
        nanos = F.when(F.col("u.cost.total").isNotNull(), whole["nanos"]).when(valid & some, added)
        child = child.withColumns({"total": total, "told": told, "nanos": nanos.cast("bigint"), "time": F.coalesce("p.message.timestamp", timeutil.rfc3339_millis(F.col("p.timestamp")))})
        at, limit = "record_offset", F.lit(str(U64_MAX)).cast("decimal(20,0)")
        says = [
            _at(F.col("changed"), "an entry of the parent session has other counts here; it was kept, marked as derived"),
            *(_at(below[k], f"a negative count of {names[k]} was taken as zero") for k in names),
            _at(n["cacheWrite1h"] > n["cacheWrite"], "more hour-long cache writes than cache writes"),
            _at(n["reasoning"] > n["output"], "more reasoning than output; the output besides it was taken as zero"),
            _at(F.col("total") == 0, "usage whose counts are all zero was passed over"),
            _at(F.col("total") > limit, "usage beyond 64 bits was passed over"),
            _at((F.col("total") > 0) & (F.col("told") != F.col("total")), "the session's own total is not the sum of its counts"),
            _at(F.col("native").isNull(), "an entry of the older format has no id; it is known by its place"),
            _at((F.col("total") > 0) & F.col("time").isNull(), "no time that can be read; the file's time was taken"),
            _at(F.col("u.cost").isNotNull() & F.col("nanos").isNull(), "the provider's price has no readable total and was left out"),
            _at(F.col("u.cost").isNotNull() & ~valid, "a part of the provider's price can't be read"),
            _at(F.col("u.cost.total").isNotNull() & valid & some & (added != whole["nanos"]), "the provider's price differs from the sum of its parts; its total was taken"),
        ]
        child = child.withColumn("says", F.array(*says))
        warnings = warnings.unionByName(collected(child, "says"))
        derived = F.col("doubt") | F.col("native").isNull() | (n["cacheWrite1h"] > n["cacheWrite"]) | (n["reasoning"] > n["output"]) | F.coalesce(F.col("told") != F.col("total"), F.lit(False))
        for k in names:
            derived = derived | below[k]
        child = child.filter((F.col("total") > 0) & (F.col("total") <= limit))
        raw = F.concat_ws(", ", *(F.concat(F.lit(f"{k}="), F.coalesce(F.col("u")[k], F.lit(0)).cast("string")) for k in ("input", "output", "cacheRead", "cacheWrite", "reasoning", "totalTokens")))
        records = _records(
            child, event_id=F.concat(F.lit("pi-v1:"), "source_key", F.lit(":"), F.coalesce("native", F.concat(F.lit("legacy-offset:"), F.col(at).cast("string")))), session_id=F.col("h.id"), client=F.lit("pi"),
            provider=F.when(message, F.nullif("p.message.provider", F.lit(""))), model=F.coalesce(F.when(message, model), F.lit("unknown")), occurred_at_unix_ms=F.coalesce("time", "modified_unix_ms"), **{b: F.col(b) for b in BUCKETS},
            source_reported_total=F.col("told"), confidence=F.when(derived, "derived").otherwise("exact"), native_id=F.col("native"), schema_variant=F.concat(F.lit("pi-session-jsonl-v"), F.col("h.version").cast("string")),
            timestamp_origin=F.when(F.col("time").isNull(), "file_modified").otherwise("source"), normalization_notes=F.array(F.concat(F.lit("raw usage: "), raw)),
            costs=F.when(F.col("nanos").isNotNull(), F.array(F.struct(F.lit("provider_reported").alias("kind"), F.col("nanos").alias("usd_nanos"), F.lit("exact").alias("confidence")))).otherwise(F.array()),
        )
        return Batch(records, warnings, ends, after, kept)


def _header_id(path: str) -> str | None:
    import json

    from tallywheel.sources.lines import lines_between, opened

    with opened(path) as file:
        first = next((x for _, lines, _ in lines_between(file, 0, 0, 1 << 16) for x in lines if x.strip()), b"")
    try:
        head = json.loads(first)
        return (head.get("id") or None) if head.get("type") == "session" else None
    except (ValueError, AttributeError):
        return None


# -- streams of a terminal client

_A_TOKENS = "input_tokens:bigint,output_tokens:bigint,cache_creation_input_tokens:bigint,cache_read_input_tokens:bigint"
_A = f"type string, parent_tool_use_id string, session_id string, message struct<model:string,usage:struct<model:string,{_A_TOKENS},iterations:array<struct<model:string,{_A_TOKENS}>>>>"


class StreamLines(_LineFiles):
    """A stream of messages; of an answer's iterations the last one has the whole usage."""

    id = "amp-stream-json"

    def read(self, spark, candidates, offsets=None, states=None):
        kept = []
        lines, warnings, ends = read_lines(spark, candidates, offsets, kept)
        rows = lines.withColumn("a", _json("line", _A))
        u = F.col("a.message.usage")
        last = F.when(F.size(u["iterations"]) > 0, F.element_at(u["iterations"], -1))
        pick = lambda c: F.coalesce(F.when(last.isNotNull(), last[c]).otherwise(u[c]), F.lit(0))
        rows = rows.withColumns({"input_tokens": pick("input_tokens"), "output_tokens": pick("output_tokens"), "cache_read_tokens": pick("cache_read_input_tokens"), "cache_write_tokens": pick("cache_creation_input_tokens"), "reasoning_tokens": F.lit(0).cast("bigint")})
        ok = F.coalesce(F.col("a").isNotNull() & F.col("a.__bad").isNull() & F.col("a.type").isNotNull() & (F.least(*BUCKETS) >= 0), F.lit(False))
        rows = rows.withColumn("ok", ok)
        own = F.col("ok") & (F.col("a.type") == "assistant") & F.col("a.parent_tool_use_id").isNull()
        rows = rows.withColumns({"own": own, "total": _sum(*(F.col(b) for b in BUCKETS))})
        at = "record_offset"
        here = F.col("own") & F.col("a.session_id").isNotNull() & F.col("a.message").isNotNull()
        over = F.col("total") > F.lit(str(U64_MAX)).cast("decimal(20,0)")
        says = F.array(
            _at(~F.col("ok"), "this line is no stream record and was passed over"),
            _at(F.col("own") & F.col("a.session_id").isNull(), "an answer that names no session was passed over"),
            _at(F.col("own") & F.col("a.session_id").isNotNull() & F.col("a.message").isNull(), "an answer without its message was passed over"),
            _at(here & u.isNotNull() & (F.col("total") == 0), "an answer that counts nothing was passed over"),
            _at(here & u.isNotNull() & over, "an answer beyond 64 bits was passed over"),
        )
        warnings = warnings.unionByName(collected(rows.withColumn("says", says), "says"))
        rows = rows.filter(here & u.isNotNull() & (F.col("total") > 0) & ~over)
        model = F.coalesce(F.when(last.isNotNull(), last["model"]).otherwise(u["model"]), "a.message.model", F.lit("unknown"))
        records = _records(
            rows, event_id=F.concat(F.lit("amp-stream-v1:"), identity.sha256_of("amp-stream-v1", F.col("a.session_id"), F.col(at))), session_id=F.col("a.session_id"), client=F.lit("amp"), model=model, occurred_at_unix_ms=F.col("modified_unix_ms"),
            **{b: F.col(b) for b in BUCKETS}, confidence=F.lit("exact"), schema_variant=F.when(last.isNotNull(), "amp-stream-json-v1-iterations").otherwise("amp-stream-json-v1"), timestamp_origin=F.lit("file_modified"),
            normalization_notes=_notes("the stream has no times; the file's time was used", _note(last.isNotNull(), "the last iteration was used"), _note(model == "unknown", "no model was named")),
        )
        return Batch(records, warnings, ends, kept=kept)
