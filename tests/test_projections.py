"""What commits keep of days and sessions is what reading all events anew would give; scans that find nothing new open nothing."""

import os
import random

from tallywheel.operators import ledger as ledger_module
from tallywheel.operators.ledger import Commit, Ledger
from tallywheel.plans import queries as Q
from tallywheel.sources.readers import EventLines
from tallywheel.streaming import incremental
from tallywheel.streaming.incremental import scan
from tests.test_collect import put
from tests.test_ledger import DAY, record

DAY_MS = 86_400_000


def rows(df):
    return sorted(tuple(sorted(r.asDict().items())) for r in df.collect())


def same(ledger):
    events = ledger.table("usage_events")
    assert rows(ledger.daily()) == rows(Q.daily_usage(events))
    assert rows(ledger.sessions()) == rows(Q.session_spans(events))


def test_projections_after_each_kind_of_commit(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger_module, "MOST_PARTS", 2)
    rng = random.Random(7)
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    ledger.register_sources({"id": "i", "adapter_id": "a", "root_path": "/r"}, [{"id": s, "native_path": s, "kind": "append_only_jsonl", "parser_version": 1} for s in "xyz"])
    known = {}

    def event(source, n):
        key = source, f"e{n}"
        known.setdefault(key, {"source_object_id": source, "event_id": f"e{n}", "session_id": rng.choice([None, "s1", "s2"]), "client": rng.choice("cd"), "occurred_at_unix_ms": DAY + rng.randint(-40, 40) * DAY_MS, "input_tokens": n, "output_tokens": 1})
        return known[key]

    same(ledger)
    ledger.apply_all([Commit("x"), Commit("y")], record(spark, *(event(s, n) for s in "xy" for n in range(6))), 1)
    same(ledger)
    ledger.apply_all([Commit("x"), Commit("z")], record(spark, *(event("x", n) for n in range(3, 9)), event("z", 1)), 2)  # late rows, rows again
    same(ledger)
    ledger.apply_all([Commit("x", "replace"), Commit("y")], record(spark, event("x", 2), event("y", 30)), 3)  # fewer, which narrows its sessions
    same(ledger)
    ledger.apply_all([Commit("y"), Commit("x")], record(spark, event("y", 31), event("x", 40)), 4)  # y has too many parts: they become one
    assert all(len(p) <= 3 for p in ledger._parts("session_parts").values())
    same(ledger)
    before = ledger._parts("daily_usage_utc")
    ledger.apply_all([Commit("z")], record(spark, {**event("z", 50), "occurred_at_unix_ms": DAY}), 5)
    changed = [m for m, p in ledger._parts("daily_usage_utc").items() if before.get(m) != p]
    assert changed == ["2024-01"]  # no other month is written
    ledger.apply_all([Commit(s, "replace") for s in "xyz"], record(spark).limit(0), 6)
    assert ledger.daily().count() == 0 and ledger.sessions().count() == 0
    same(ledger)


def test_a_ledger_without_projections_gets_them(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    ledger.register_source("s1", {"id": "i1", "adapter_id": "a1", "root_path": "/r"}, "f1")
    ledger.append("s1", record(spark, {"event_id": "a", "session_id": "s", "input_tokens": 3}), 1)
    ledger._publish({"daily_usage_utc": {}, "session_parts": {}})
    ledger.rebuild_projections()
    same(ledger)


def test_unchanged_files_are_not_opened(spark, tmp_path, monkeypatch):
    line = lambda n: {"id": f"e{n}", "client": "c", "model": "m", "occurred_at_unix_ms": DAY, "input": n}
    for k in range(3):
        put(tmp_path / f"in/f{k}.jsonl", [line(k * 10 + n) for n in range(4)])
    ledger, reader = Ledger(spark, str(tmp_path / "ledger")), [("i", EventLines(tmp_path / "in"))]
    assert scan(ledger, reader, 1000).inserted == 12
    hashed, real = [], incremental.digests
    monkeypatch.setattr(incremental, "digests", lambda spark, paths: hashed.append(set(paths)) or real(spark, paths))
    got = scan(ledger, reader, 2000)
    assert (got.processed, got.inserted) == (0, 0) and not any(hashed)
    path = put(tmp_path / "in/f1.jsonl", [line(10 + n) for n in range(6)])
    os.utime(path, ns=(1, 10**18))
    got = scan(ledger, reader, 3000)
    assert (got.processed, got.inserted, got.duplicates) == (1, 2, 0) and set.union(*hashed) == {str(path)}
    # The same size, another time, other bytes before the end: read anew.
    path.write_text(path.read_text().replace('"input": 10', '"input": 77'))
    os.utime(path, ns=(1, 2 * 10**18))
    got = scan(ledger, reader, 4000)
    assert (got.processed, got.deleted, got.inserted) == (1, 6, 6)
    same(ledger)
