"""The ledger's contract: exactly once, whole or not at all, owned by source; and scans that resume."""

import csv
import json
import os
import threading
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tallywheel import schema
from tallywheel.operators.ledger import Checkpoint, Commit, IdentityConflict, InvalidRecord, Ledger
from tallywheel.operators.pricing import RateDataset, estimate
from tallywheel.plans import queries as Q
from tallywheel.plans.export import export, write_reconciliation
from tallywheel.sources.readers import EventLines, StreamLines, WireJournals
from tallywheel.sources.threads import Threads
from tallywheel.streaming.incremental import Cancelled, Scan, read_daily, scan, stream_daily
from tests.test_collect import WIRE, put

DAY = 1704067200000


def record(spark, *events):
    fields = schema.RECORD.split(", ")
    names = [f.split(" ")[0] for f in fields]
    base = dict.fromkeys(names) | {"client": "c", "model": "m", "occurred_at_unix_ms": DAY, **dict.fromkeys(schema.BUCKETS, 0), "confidence": "exact", "schema_variant": "v1", "timestamp_origin": "source", "normalization_notes": [], "costs": [], "record_offset": 0}
    return spark.createDataFrame([[({**base, **e})[n] for n in names] for e in events], schema.struct(schema.RECORD))


@pytest.fixture
def ledger(spark, tmp_path):
    out = Ledger(spark, str(tmp_path / "ledger"))
    out.register_source("s1", {"id": "i1", "adapter_id": "a1", "root_path": "/r"}, "f1")
    return out


def facts(ledger):
    return Q.facts(ledger.table("usage_events"), ledger.table("event_costs"))


def test_append_is_idempotent_and_conflicts_change_nothing(spark, ledger):
    e = {"event_id": "e1", "input_tokens": 10, "costs": [("provider_reported", 5, "exact")], "session_id": "x"}
    assert ledger.append("s1", record(spark, e), 1).inserted == 1
    again = ledger.append("s1", record(spark, {**e, "record_offset": 99}), 2)
    assert (again.inserted, again.duplicates) == (0, 1)
    assert [(r["day"], r["input_tokens"], r["event_count"]) for r in Q.daily_usage(ledger.table("usage_events")).collect()] == [("2024-01-01", 10, 1)]
    for change in ({"input_tokens": 11}, {"schema_variant": "v2"}, {"costs": [("provider_reported", 6, "exact")]}):
        with pytest.raises(IdentityConflict):
            ledger.append("s1", record(spark, {"event_id": "e0"}, {**e, **change}), 3)
    assert ledger.table("usage_events").count() == 1
    assert Q.last_runs(ledger.table("ingest_runs")).first()["run"]["status"] == "failed"
    # Estimates are the ledger's own: a source may show its event again after repricing.
    ledger.reprice(RateDataset(rates={"m": (1, 1, 1, 1, 1)}, aliases={}), 4)
    assert ledger.append("s1", record(spark, e), 5).duplicates == 1


def test_invalid_records_are_refused(spark, ledger):
    for change in ({"input_tokens": -1}, {"confidence": "sure"}, {"costs": [("provider_reported", None, "exact")]}, {"costs": [("unpriced", 1, "exact")]}, {"client": None}):
        with pytest.raises(InvalidRecord):
            ledger.append("s1", record(spark, {"event_id": "e1", **change}), 1)
    assert ledger.table("usage_events").count() == 0


def test_replace_owns_its_source_only(spark, ledger):
    ledger.register_source("s2", {"id": "i1", "adapter_id": "a1", "root_path": "/r"}, "f2")
    ledger.append("s1", record(spark, {"event_id": "a", "costs": [("provider_reported", 5, "exact")]}, {"event_id": "b"}), 1)
    ledger.append("s2", record(spark, {"event_id": "a", "input_tokens": 3}), 2)
    report = ledger.replace("s1", record(spark, {"event_id": "c"}), 3)
    assert (report.deleted, report.inserted) == (2, 1)
    assert sorted((r[0], r[1]) for r in ledger.table("usage_events").select("source_object_id", "event_id").collect()) == [("s1", "c"), ("s2", "a")]
    assert ledger.table("event_costs").count() == 0
    with pytest.raises(InvalidRecord):
        ledger.replace("s1", record(spark, {"event_id": "d", "input_tokens": -1}), 4)
    assert ledger.table("usage_events").count() == 2
    assert ledger.replace("s1", record(spark).limit(0), 5).deleted == 1  # an empty replacement clears
    assert [r["source_object_id"] for r in ledger.table("usage_events").collect()] == ["s2"]


def test_installations_checkpoints_and_health(spark, ledger):
    state = lambda: {r["source_object_id"]: r["state"] for r in Q.source_health(ledger.table("source_objects"), ledger.table("source_installations"), ledger.table("ingest_runs"), ledger.table("usage_events")).collect()}
    assert state() == {"s1": "setup"} and ledger.checkpoint_status("s1", 1) == ("never_ingested", None)
    ledger.append("s1", record(spark, {"event_id": "a"}), 1)
    assert state() == {"s1": "healthy"} and ledger.checkpoint_status("s1", 1)[0] == "current" and ledger.checkpoint_status("s1", 2)[0] == "invalidated"
    ledger.append("s1", record(spark).limit(0), 2, warnings=["a line is malformed"])
    assert state() == {"s1": "partial"}
    ledger.append("s1", record(spark).limit(0), 3, warnings=["session schema is newer than version 3"])
    assert state() == {"s1": "unsupported"}
    ledger.fail("s1", 4, "io", "disk")
    assert state() == {"s1": "error"}
    ledger.fail("s1", 5, "permission_denied", "no")
    assert state() == {"s1": "permission_denied"}
    ledger.append("s1", record(spark).limit(0), 6)
    assert state() == {"s1": "healthy"}
    ledger.set_installation_state("i1", False, "granted")
    assert state() == {"s1": "disabled"}
    ledger.register_source("s1", {"id": "i1", "adapter_id": "a1", "root_path": "/r"}, "f1")
    assert state() == {"s1": "disabled"} and ledger.source_exists("s1") and not ledger.source_exists("s9")
    with pytest.raises(KeyError):
        ledger.set_installation_state("i9", True, "granted")


def test_due_sources(spark, ledger):
    due = lambda now: Q.due_sources(ledger.table("source_objects"), ledger.table("source_installations"), ledger.table("ingest_runs"), now, 1000).count()
    assert due(0) == 1
    ledger.replace("s1", record(spark, {"event_id": "a"}), 2000)
    ledger.append("s1", record(spark, {"event_id": "b"}), 2900)
    assert (due(2999), due(3000)) == (0, 1)
    ledger.set_installation_state("i1", False, "granted")
    assert due(9000) == 0


def test_overview_activity_sessions_and_repricing(spark, ledger):
    ledger.register_source("s2", {"id": "i2", "adapter_id": "a2", "root_path": "/r"}, "f")
    at = lambda d, h=0: DAY + (d - 1) * 86_400_000 + h * 3_600_000
    ledger.append("s1", record(
        spark,
        {"event_id": "1", "session_id": "x", "provider": "a", "model": "priced", "occurred_at_unix_ms": at(7), "input_tokens": 8, "output_tokens": 2, "costs": [("provider_reported", 200_000_000, "exact")]},
        {"event_id": "2", "session_id": "x", "provider": "b", "model": "other", "occurred_at_unix_ms": at(7) + 60_000, "input_tokens": 10, "confidence": "derived"},
    ), 1)
    ledger.append("s2", record(spark, {"event_id": "3", "session_id": "x", "model": "other", "occurred_at_unix_ms": at(8), "input_tokens": 10, "confidence": "estimated"}), 2)
    assert ledger.reprice(RateDataset(rates={"priced": (1000, 1000, 1, 1, 1)}, aliases={}), 3) == {"priced": 1, "unpriced": 2}
    o = Q.overview(facts(ledger)).first()
    assert (o["input_tokens"], o["output_tokens"], o["event_count"], o["session_count"], o["active_days"], o["model_count"], o["reported_nanos"], o["estimate_nanos"], o["unpriced_events"]) == (28, 2, 3, 2, 2, 3, 200_000_000, 10_000, 2)
    assert (o["exact_events"], o["derived_events"], o["estimated_events"]) == (1, 1, 1)
    weeks = {r["period"]: (r["total_tokens"], r["estimate_nanos"], r["unpriced_events"]) for r in Q.activity(facts(ledger), "weekly", "client").collect()}
    assert weeks == {"2024-01-01": (20, 10_000, 1), "2024-01-08": (10, None, 1)}
    s = Q.session_summaries(facts(ledger)).filter("source_object_id = 's1'").first()
    assert (s["total_tokens"], s["event_count"], s["confidence"], s["providers"], s["models"], s["duration_ms"], s["reported_nanos"], s["estimate_nanos"], s["unpriced_events"]) == (20, 2, "derived", "a,b", "other,priced", 60_000, 200_000_000, 10_000, 1)
    assert ledger.reprice(RateDataset(rates={"priced": (1000, 1000, 1, 1, 1), "other": (100, 1, 1, 1, 1)}, aliases={}), 4) == {"priced": 3, "unpriced": 0}
    o = Q.overview(facts(ledger)).first()
    assert (o["reported_nanos"], o["estimate_nanos"]) == (200_000_000, 12_000)
    total = sum(r["total_tokens"] for r in Q.activity(facts(ledger), "daily", "model").collect())
    assert total == o["total_tokens"]
    data = RateDataset(rates={"priced": (1000, 1000, 1, 1, 1), "other": (100, 1, 1, 1, 1)}, aliases={})
    status = Q.pricing_status(ledger.table("usage_events"), ledger.table("event_costs"), ledger.table("pricing_snapshots"))
    assert not Q.needs_repricing(status, ledger.table("usage_events"), data.source, data.version, data.content_hash())
    assert Q.needs_repricing(status, ledger.table("usage_events"), data.source, "next", data.content_hash())
    assert ledger.record_snapshot(data, 99) == status.first()["id"]


def test_exports(spark, ledger, tmp_path):
    ledger.append("s1", record(spark, {"event_id": 'a,"b', "provider": "moonshot", "model": "model-priced", "input_tokens": 10, "output_tokens": 2, "source_reported_total": 12}), 1)
    ledger.reprice(RateDataset(rates={"moonshot/model-priced": (10_000_000, 10_000_000, 0, 0, 0)}, aliases={}), 2)
    path, n = export(facts(ledger), tmp_path / "out", "csv", 1787046083000)
    assert n == 1 and path.name.startswith("events-20260818-094123-") and path.name.endswith(".csv")
    rows = list(csv.reader(path.open()))
    assert rows[0] == list(Q.EXPORT_COLUMNS) and len(rows[0]) == 19 and rows[1][0] == 'a,"b'
    assert ",moonshot,model-priced,10,2,0,0,0,12,12,exact,,0.12," in path.read_text()
    assert export(facts(ledger), tmp_path / "out", "csv", 1787046083000)[0] == path
    path, _ = export(facts(ledger), tmp_path / "out", "json", 5)
    doc = json.loads(path.read_text())
    assert doc["eventCount"] == 1 and doc["events"][0]["tokens"] == {"input": 10, "output": 2, "cacheRead": 0, "cacheWrite": 0, "reasoning": 0}
    assert "notes" not in path.read_text().lower() and "path" not in path.read_text().lower()


def test_reconciliation_report_and_session_sources(spark, ledger, tmp_path):
    ledger.register_source("s2", {"id": "i2", "adapter_id": "a2", "root_path": "/r"}, "f2", parser_version=3)
    ledger.append("s1", record(spark, {"event_id": "a", "input_tokens": 4, "output_tokens": 1, "source_reported_total": 5, "session_id": "x"}), 9)
    events, objects, inst = (ledger.table(t) for t in ("usage_events", "source_objects", "source_installations"))
    totals = Q.adapter_totals(events, objects, inst)
    checks = Q.cross_check(totals, spark.createDataFrame([("a1", "own", 5), ("a2", "own", 1)], "adapter_id string, reference string, expected_total long"))
    assert write_reconciliation(Q.report_sources(events, objects, inst), checks, tmp_path / "r.json", 77) == 2
    doc = json.loads((tmp_path / "r.json").read_text())
    assert (doc["format"], doc["generatedAtUnixMs"]) == (1, 77)
    got = [(s["adapter_id"], s["source_object_id"], s["parser_version"], s["last_success_unix_ms"], s["status"], s["event_count"], s["total_tokens"]) for s in doc["sources"]]
    assert got == [("a1", "s1", 1, 9, "match", 1, 5), ("a2", "s2", 3, None, "unavailable", 0, 0)]
    assert [(c["adapter_id"], c["actual_total"], c["status"]) for c in doc["referenceChecks"]] == [("a1", 5, "match"), ("a2", None, "unavailable")]
    assert "/r" not in (tmp_path / "r.json").read_text()
    rows = Q.session_sources(Q.session_summaries(facts(ledger)), objects, inst).collect()
    assert [(r["session_id"], r["installation_id"], r["adapter_id"], r["source_kind"], r["parser_version"]) for r in rows] == [("x", "i1", "a1", "append_only_jsonl", 1)]


def test_newer_ledgers_are_refused(spark, tmp_path):
    (tmp_path / "pointer.json").write_text(json.dumps({"version": 99, "commit": 0, "tables": {}}))
    with pytest.raises(ValueError, match="99"):
        Ledger(spark, str(tmp_path))


def test_rates(spark):
    events = spark.createDataFrame([("openai", "gpt-test", 1), ("", "gpt-test", 1), ("x", "nick", 1), ("x", "none", 1), ("", "", 1), ("", "gpt-test", 2**62)], "provider string, model string, input_tokens long").withColumns({b: F.lit(0).cast("long") for b in schema.BUCKETS[1:]})
    data = RateDataset(rates={"gpt-test": (3, 1, 1, 1, 1), "openai/gpt-test": (5, 1, 1, 1, 1)}, aliases={"nick": "gpt-test"})
    got = [(r["usd_nanos"], r["pricing_key"], r["pricing_rule"]) for r in estimate(events, data).collect()]
    assert got == [(5, "openai/gpt-test", "exact"), (3, "gpt-test", "exact"), (3, "gpt-test", "alias:nick"), (None, None, "unpriced:no-match"), (None, None, "unpriced:no-match"), (None, None, "unpriced:overflow")]
    assert data.content_hash() == RateDataset(rates=dict(reversed(data.rates.items())), aliases=data.aliases).content_hash()


def test_scan_resumes_replaces_and_retains(spark, tmp_path):
    home = tmp_path / "home"
    path = put(home / "sessions/wd/session_a/agents/main/wire.jsonl", WIRE)
    ledger, readers = Ledger(spark, str(tmp_path / "ledger")), [("i1", WireJournals(home))]
    first = scan(ledger, readers, 1000, dataset=RateDataset())
    assert (first.inserted, first.processed, first.discovered) == (2, 1, 1)
    assert scan(ledger, readers, 2000).processed == 0  # nothing new
    with path.open("a") as f:
        f.write(json.dumps({"type": "usage.record", "model": "__m__", "usage": {"inputOther": 500, "output": 10, "inputCacheRead": 2000}, "time": 1782113204943}) + "\n")
    more = scan(ledger, readers, 3000, dataset=RateDataset())
    assert (more.inserted, more.duplicates, more.deleted) == (1, 0, 0)
    daily = Q.daily_usage(ledger.table("usage_events")).first()
    assert (daily["input_tokens"], daily["output_tokens"], daily["cache_read_tokens"], daily["model"]) == (4564, 106, 16848, "kimi-for-coding")
    assert ledger.table("event_costs").filter("kind = 'api_equivalent_estimate'").count() == 3
    put(path, WIRE[:3])
    rewritten = scan(ledger, readers, 4000)
    assert (rewritten.deleted, rewritten.inserted) == (3, 1)
    os.remove(path)
    assert scan(ledger, readers, 5000).discovered == 0
    assert ledger.table("usage_events").count() == 1


def test_scan_isolates_failures(spark, tmp_path):
    root = tmp_path / "threads"
    good = {"id": "T-a", "created": 1704067200000, "usageLedger": {"events": [{"timestamp": "2024-01-01T00:00:00Z", "model": "model-a", "tokens": {"input": 10, "output": 2}}, {"timestamp": "2024-01-01T00:00:00Z", "model": "model-a", "tokens": {"input": 1}}]}}
    root.mkdir()
    (root / "T-a.json").write_text(json.dumps(good))
    (root / "T-b.json").write_text("nonsense")
    ledger, readers = Ledger(spark, str(tmp_path / "ledger")), [("i1", Threads(root))]
    got = scan(ledger, readers, 1000)
    assert got.failed == ["amp-threads:T-b.json"] and got.inserted == 2
    good["usageLedger"]["events"].pop()
    (root / "T-a.json").write_text(json.dumps(good))
    got = scan(ledger, readers, 2000)
    assert (got.deleted, got.inserted) == (2, 1)
    stop = Scan(cancel=threading.Event())
    stop.cancel.set()
    (root / "T-a.json").write_text(json.dumps({**good, "created": 1}))
    with pytest.raises(Cancelled):
        scan(ledger, readers, 3000, stop)
    assert ledger.table("usage_events").count() == 1


def test_one_commit_of_several_sources(spark, ledger):
    for n in range(2, 7):
        ledger.register_source(f"s{n}", {"id": f"i{n % 2}", "adapter_id": "a1", "root_path": "/r"}, f"f{n}")
    cost = {"costs": [("provider_reported", 5, "exact")]}
    ledger.apply_all([Commit("s2"), Commit("s3"), Commit("s4")], record(spark, *({"source_object_id": s, "event_id": e, **cost} for s in ("s2", "s3", "s4") for e in "ab")), 1)
    before = ledger._state()["commit"]
    rows = [
        {"source_object_id": "s1", "event_id": "a", "input_tokens": 4},  # new source
        {"source_object_id": "s2", "event_id": "a", **cost}, {"source_object_id": "s2", "event_id": "c"},  # one known, one new
        {"source_object_id": "s3", "event_id": "z"}, {"source_object_id": "s3", "event_id": "z"},  # replaced, twice the same
        {"source_object_id": "s5", "event_id": "a", "input_tokens": -1}, {"source_object_id": "s5", "event_id": "b"},  # refused whole
        {"source_object_id": "s6", "event_id": "a"}, {"source_object_id": "s6", "event_id": "a", "model": "other"},  # two facts
        {"source_object_id": "s9", "event_id": "a"},  # not of this commit
    ]
    commits = [Commit("s1", checkpoint=Checkpoint(7, 9, "p", "w")), Commit("s2"), Commit("s3", "replace"), Commit("s4", "replace", warnings=["w"]), Commit("s5"), Commit("s6")]
    got = ledger.apply_all(commits, record(spark, *rows), 2)
    assert {s: (r.seen, r.inserted, r.duplicates, r.deleted) for s, r in got.items() if not isinstance(r, Exception)} == {"s1": (1, 1, 0, 0), "s2": (2, 1, 1, 0), "s3": (2, 1, 1, 2), "s4": (0, 0, 0, 2)}
    assert isinstance(got["s5"], InvalidRecord) and isinstance(got["s6"], IdentityConflict)
    assert ledger._state()["commit"] == before + 1
    stored = sorted((r[0], r[1]) for r in ledger.table("usage_events").select("source_object_id", "event_id").collect())
    assert stored == [("s1", "a"), ("s2", "a"), ("s2", "b"), ("s2", "c"), ("s3", "z")]
    assert sorted(r[0] for r in ledger.table("event_costs").select("source_object_id").collect()) == ["s2", "s2"]
    runs = {r["source_object_id"]: (r["id"], r["status"], r["warnings"]) for r in ledger.table("ingest_runs").filter("finished_unix_ms = 2").collect()}
    assert runs == {s: (4 + n, "failed" if s in ("s5", "s6") else "completed", ["w"] if s == "s4" else []) for n, s in enumerate(["s1", "s2", "s3", "s4", "s5", "s6"])}
    assert ledger.checkpoint_status("s1", 1) == ("current", Checkpoint(7, 9, "p", "w")) and ledger.checkpoint_status("s5", 1)[0] == "never_ingested"
    with pytest.raises(IdentityConflict):
        ledger.append("s2", record(spark, {"event_id": "a", "model": "x", **cost}), 3)


def test_scan_of_several_files(spark, tmp_path):
    """Several commits, progress after each, files of a kind that the reader doesn't read, names that paths must quote."""
    home, names = tmp_path / "a b+c%41", ["session_a", "session_b", "session_c d", "session_é"]
    for name in names:
        put(home / f"sessions/wd/{name}/agents/main/wire.jsonl", WIRE)

    class Odd(WireJournals):
        def discover(self, spark=None):
            *good, last = super().discover(spark)
            return [*good, replace(last, kind="mutable_json")]

    seen = []
    got = scan(Ledger(spark, str(tmp_path / "ledger")), [("i1", Odd(home))], 1000, Scan(progress=lambda s: seen.append((s.discovered, s.processed))), commit_sources=2)
    assert seen == [(4, 0), (4, 2), (4, 3)] and (got.processed, got.inserted, len(got.failed)) == (3, 6, 1)
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    assert [r["error"] for r in ledger.table("ingest_runs").filter("status = 'failed'").collect()] == ["[schema] kimi-wire doesn't read mutable_json"]
    assert scan(ledger, [("i1", WireJournals(home))], 2000).processed == 1  # the one that failed
    assert scan(ledger, [("i1", WireJournals(home))], 3000).processed == 0


def test_scan_of_lines_and_streams(spark, tmp_path):
    path = put(tmp_path / "s.jsonl", [{"type": "assistant", "message": {"usage": {"input_tokens": 10, "output_tokens": 2}}, "session_id": "s"}])
    own = put(tmp_path / "e.jsonl", [{"id": "1", "client": "c", "model": "m", "occurred_at_unix_ms": 1, "input": 1}])
    ledger, readers = Ledger(spark, str(tmp_path / "ledger")), [("i1", StreamLines(path)), ("i2", EventLines(own))]
    assert scan(ledger, readers, 1).inserted == 2
    with path.open("a") as f:
        f.write(json.dumps({"type": "assistant", "message": {"usage": {"input_tokens": 20, "output_tokens": 4}}, "session_id": "s"}) + "\n")
    assert scan(ledger, readers, 2).inserted == 1
    sums = Q.adapter_totals(ledger.table("usage_events"), ledger.table("source_objects"), ledger.table("source_installations"))
    assert {r["adapter_id"]: r["total_tokens"] for r in sums.collect()} == {"amp-stream-json": 36, "reference-jsonl": 1}


def test_streaming_projection_equals_a_rebuild(spark, tmp_path):
    kind = schema.struct(schema.TABLES["usage_events"])
    events = record(spark, *({"event_id": str(i), "input_tokens": i, "occurred_at_unix_ms": DAY + i * 20_000_000, "provider": ""} for i in range(20))).select(*kind.fieldNames()).fillna("s", ["source_object_id"])
    for part in range(2):
        events.filter(F.col("event_id").cast("int") % 2 == part).write.mode("append").parquet(str(tmp_path / "in"))
        stream_daily(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), str(tmp_path / "daily"), str(tmp_path / "cp")).start().awaitTermination()
    cols = ["day", "client", "provider", "model", *schema.BUCKETS, "event_count"]
    assert sorted(map(tuple, read_daily(spark, str(tmp_path / "daily")).select(*cols).collect())) == sorted(map(tuple, Q.daily_usage(events).select(*cols).collect()))


def test_exports_are_written_by_tasks(spark, tmp_path, monkeypatch):
    """Rows of an export don't come to the driver; what is written is what a plain writer writes."""
    import io

    from pyspark.sql import functions as F

    from tallywheel.plans import export as x

    odd = [None, "", 'a "b"', "c,d", "e\nf", "g\rh", "ü"]
    rows = spark.range(0, 700, 1, 7).withColumn("text", F.element_at(F.array(*(F.lit(t) for t in odd)), (F.col("id") % 7 + 1).cast("int")))
    rows = rows.select("id", "text", (F.col("id") % 2 == 0).alias("even")).orderBy("id")
    monkeypatch.setattr(x, "ordered", lambda facts: facts)
    monkeypatch.setattr(x, "EXPORT_COLUMNS", tuple(rows.columns))
    monkeypatch.setattr(type(rows), "toLocalIterator", None)
    assert x.write_csv(rows, tmp_path / "a.csv") == 700
    plain = io.StringIO()
    out = csv.writer(plain, lineterminator="\n", quoting=csv.QUOTE_MINIMAL)
    out.writerows([rows.columns, *([k, odd[k % 7] or "", str(k % 2 == 0).lower()] for k in range(700))])
    assert (tmp_path / "a.csv").read_bytes() == plain.getvalue().encode()
    assert x.write_csv(rows.limit(0), tmp_path / "b.csv") == 0 and (tmp_path / "b.csv").read_text() == "id,text,even\n"
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.csv", "b.csv"]


def test_commits_cache_no_records(spark, tmp_path, monkeypatch):
    """What a commit reads several times is a table: the partitions of what is cached stay as many as a shuffle has."""
    from tallywheel.plans.checks import records_of

    frame = type(spark.range(0))
    cached, persist = [], frame.persist
    monkeypatch.setattr(frame, "persist", lambda self, *how: cached.append(self.columns) or persist(self, *how))
    ledger = Ledger(spark, tmp_path / "ledger")
    ledger.register_sources({"id": "i", "adapter_id": "own", "root_path": "/r"}, [{"id": "src-0", "native_path": "f", "kind": "append_only_jsonl", "parser_version": 1}])
    rows = records_of(spark.range(40).selectExpr("id AS n", "0L AS u", "id * 1000 AS ms", "'x' AS event_type"))
    assert ledger.append("src-0", rows, 1).inserted == 40
    again = ledger.append("src-0", rows, 2)
    assert (again.inserted, again.duplicates) == (0, 40) and ledger.table("usage_events").count() == 40
    assert cached and not any("event_id" in columns for columns in cached)


def test_warnings_of_a_scan_stay_out_of_the_driver(spark, tmp_path, monkeypatch):
    """Two files with many odd lines, one with two lines that aren't UTF-8: the run log has every warning, the driver none."""
    good = '{"id":"e-%d","session_id":"s","client":"c","model":"m","occurred_at_unix_ms":1,"input":%d}'
    for name, odd in (("a", 400), ("b", 300), ("fine", 0)):
        put(tmp_path / f"in/{name}.jsonl", [good % (n, n) if n % 2 == 0 else "{bad" for n in range(odd * 2 or 2)][: odd * 2 or 1])
    (tmp_path / "in/latin.jsonl").write_bytes(b"{bad\n" * 3 + b"\xff\n" + b"{bad\n" * 30 + b"\xff\n")
    got, sent, kind, make = [], [], type(spark.range(0)), type(spark).createDataFrame
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda df: got.append(collect(df)) or got[-1])
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *rest, **more: sent.append(str(data)) or make(self, data, *rest, **more))
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    done = scan(ledger, [("i", EventLines(tmp_path / "in"))], 1)
    monkeypatch.undo()
    assert (done.processed, done.inserted, done.failed) == (3, 701, ["reference-jsonl:latin.jsonl"])
    assert max(len(rows) for rows in got) <= 10 and not any("passed over" in str(x) for x in [*got, *sent])
    runs = {r["source_object_id"][16:-6]: r for r in ledger.table("ingest_runs").collect()}
    assert {k: (len(r["warnings"]), len(set(r["warnings"])), r["status"]) for k, r in runs.items()} == {"a": (400, 400, "completed"), "b": (300, 300, "completed"), "fine": (0, 0, "completed"), "latin": (0, 0, "failed")}
    assert runs["latin"]["error"] == "[encoding] bytes at 15 are not UTF-8"
    stored = {(r["run_id"], r["source_object_id"], r["warning"]) for r in ledger.table("ingest_warnings").collect()}
    assert stored == {(r["id"], r["source_object_id"], w) for r in runs.values() for w in r["warnings"]}
    health = Q.source_health(*(ledger.table(t) for t in ("source_objects", "source_installations", "ingest_runs", "usage_events"))).collect()
    assert {r["source_object_id"][16:-6]: (r["state"], r["warning_count"]) for r in health} == {"a": ("partial", 400), "b": ("partial", 300), "fine": ("healthy", 0), "latin": ("error", 0)}
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "run_id" not in plan(ledger.table("ingest_runs").select("id", "status")) and "run_id" in plan(ledger.table("ingest_runs"))
    with (tmp_path / "in/a.jsonl").open("a") as file:
        file.write("{bad\n")
    scan(ledger, [("i", EventLines(tmp_path / "in"))], 2)
    ledger.append("reference-jsonl:fine.jsonl", record(spark).limit(0), 3, warnings=["z", "y"])
    last = {r["source_object_id"][16:-6]: r["warnings"] for r in ledger.table("ingest_runs").filter("id > 4").collect()}
    assert len(last["a"]) == 1 and last["fine"] == ["z", "y"]


def test_events_meet_events_by_a_shuffle(spark, ledger):
    """Commits don't broadcast a source's events, however small their files are."""
    from tallywheel.operators.ledger import compare_again

    ledger.append("s1", record(spark, {"event_id": "a", "costs": [("provider_reported", 5, "exact")]}, {"event_id": "b"}), 1)
    stored = ledger.records("s1")
    both = compare_again(stored, stored, ["model", "__costs"])
    assert {r["event_id"]: r["conflict"] for r in both.collect()} == {"a": False, "b": False}
    assert "Broadcast" not in both._jdf.queryExecution().executedPlan().toString()
