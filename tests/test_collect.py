"""Readers against hand-made journals with known results."""

import json
import re
from collections import Counter

import pytest
import zstandard

from pyspark.sql import functions as F

from tallywheel.sources import readers
from tallywheel.sources.readers import EventLines, EventSnapshot, SessionTrees, StreamLines, WireJournals
from tallywheel.sources.rollouts import Rollouts
from tallywheel.sources.threads import Threads

UUIDS = [f"00000000-0000-4000-8000-00000000000{i}" for i in range(10)]


def put(path, lines, tail=""):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join((x if isinstance(x, str) else json.dumps(x)) + "\n" for x in lines) + tail, encoding="utf-8")
    return path


def got(spark, reader, offsets=None):
    batch = reader.read(spark, reader.discover(), offsets)
    rows = sorted(batch.records.collect(), key=lambda r: (r["source_object_id"], r["record_offset"] or 0, r["event_id"]))
    return rows, sorted(r["warning"] for r in batch.warnings.collect()), {} if batch.ends is None else {r["source_key"]: r["committed_offset"] for r in batch.ends.collect()}


def test_event_lines(spark, tmp_path):
    first = {"id": "event-001", "client": "synthetic", "model": "model-é", "occurred_at_unix_ms": 1704067200000, "input": 10, "output": 2}
    second = {"id": "event-002", "client": "synthetic", "model": "model-a", "occurred_at_unix_ms": 1704153600000, "input": 20, "cache_read": 5}
    text = json.dumps(first, ensure_ascii=False)
    path = put(tmp_path / "e.jsonl", [text, "", second, "{oops", {**first, "extra": 1}, {**first, "input": -1}], '{"id":')
    rows, warnings, ends = got(spark, EventLines(path))
    assert [(r["event_id"], r["input_tokens"], r["output_tokens"], r["cache_read_tokens"], r["record_offset"]) for r in rows] == [("event-001", 10, 2, 0, 0), ("event-002", 20, 0, 5, len(text.encode()) + 2)]
    assert len(warnings) == 4 and any("no end yet" in w for w in warnings)
    assert ends == {"e.jsonl": path.stat().st_size - len('{"id":')}
    put(tmp_path / "none.jsonl", [])
    assert got(spark, EventLines(tmp_path / "none.jsonl")) == ([], [], {"none.jsonl": 0})
    rows, _, _ = got(spark, EventLines(path), {"e.jsonl": 5})
    assert [r["event_id"] for r in rows] == ["event-002"]


def test_event_snapshot(spark, tmp_path):
    event = {"id": "a", "client": "c", "model": "m", "occurred_at_unix_ms": 5, "input": 1}
    (tmp_path / "s.json").write_text(json.dumps({"events": [event, {**event, "id": "b"}]}))
    rows, warnings, _ = got(spark, EventSnapshot(tmp_path / "s.json"))
    assert [r["event_id"] for r in rows] == ["a", "b"] and not warnings
    (tmp_path / "s.json").write_text(json.dumps({"events": [event, {"id": "b"}]}))
    rows, warnings, _ = got(spark, EventSnapshot(tmp_path / "s.json"))
    assert not rows and warnings[0].startswith("[schema]")


WIRE = [
    {"type": "metadata", "protocol_version": "1.5", "created_at": 1782113170000},
    {"type": "llm.request", "kind": "loop", "provider": "moonshot", "model": "kimi-for-coding", "time": 1782113170000},
    {"type": "usage.record", "model": "kimi-code/kimi-for-coding", "usage": {"inputOther": 3064, "output": 76, "inputCacheRead": 14848, "inputCacheCreation": 0}, "usageScope": "turn", "time": 1782113184943},
    {"type": "step.end", "usage": {"inputOther": 3064, "output": 76}},
    {"type": "usage.record", "model": "__kimi_env_model__", "usage": {"inputOther": 1000, "output": 20, "inputCacheRead": 0, "inputCacheCreation": 0}, "usageScope": "session", "time": 1782113194943},
]


def test_wire_journals(spark, tmp_path):
    put(tmp_path / "sessions/wd" / f"session_{UUIDS[1]}" / "agents/main/wire.jsonl", WIRE)
    old = {"timestamp": 1770983410.123, "message": {"type": "StatusUpdate", "payload": {"token_usage": {"input_other": 1508, "output": 205, "input_cache_read": 4864, "input_cache_creation": 0}, "message_id": "m1"}}}
    larger = json.loads(json.dumps(old))
    larger["message"]["payload"]["token_usage"]["input_other"] = 3000
    smaller = json.loads(json.dumps(old))
    smaller["message"]["payload"]["token_usage"] = {"input_other": 10, "output": 1, "input_cache_read": 2, "input_cache_creation": 0}
    put(tmp_path / "sessions" / UUIDS[2] / "wire.jsonl", [old, larger, smaller])
    put(tmp_path / "sessions/z/wire.jsonl", ["{bad", {"type": "usage.record", "usage": {"output": 0}, "time": 1}, {"type": "usage.record", "time": 1}])
    rows, warnings, _ = got(spark, WireJournals(tmp_path))
    flat = [r for r in rows if r["session_id"] == UUIDS[1]]
    assert [(r["input_tokens"], r["output_tokens"], r["cache_read_tokens"], r["model"]) for r in flat] == [(3064, 76, 14848, "kimi-for-coding"), (1000, 20, 0, "kimi-for-coding")]
    assert any("placeholder" in n for n in flat[1]["normalization_notes"]) and flat[0]["occurred_at_unix_ms"] == 1782113184943
    kept = [r for r in rows if r["session_id"] == UUIDS[2]]
    assert [(r["input_tokens"], r["record_offset"], r["model"], r["occurred_at_unix_ms"], r["native_id"]) for r in kept] == [(3000, 0, "unknown", 1770983410123, "m1")]
    assert len(rows) == 3 and len(warnings) == 4


def usage(i=0, o=0, total=0, cost=None, **more):
    return {"input": i, "output": o, "cacheRead": 0, "cacheWrite": 0, "totalTokens": total, **({"cost": cost} if cost else {}), **more}


def entry(id, u, **more):
    return {"type": "message", "id": id, "timestamp": "2024-01-01T00:00:02Z", "message": {"role": "assistant", "provider": "p", "model": "m", "timestamp": 1704067202000, "usage": u} | more}


def test_session_trees(spark, tmp_path):
    cost = {"input": 0.0004, "output": 0.0006, "cacheRead": 0, "cacheWrite": 0, "total": 0.001}
    put(tmp_path / "a/parent.jsonl", [{"type": "session", "version": 3, "id": "parent"}, entry("shared", usage(100, 20, 120, cost))])
    put(tmp_path / "a/child.jsonl", [{"type": "session", "version": 3, "id": "child", "parentSession": "/x/parent.jsonl"}, entry("shared", usage(100, 20, 120, cost)), entry("own", usage(30, 5, 35, cost)), {"type": "branch_summary", "id": "sum", "timestamp": "2024-01-01T00:01:00Z", "usage": usage(20, 5, 25)}])
    put(tmp_path / "b/new.jsonl", [{"type": "session", "version": 4, "id": "new"}, entry("x", usage(1, 1))])
    put(tmp_path / "b/odd.jsonl", [entry("early", usage(1)), {"type": "session", "id": "odd"}, entry("e1", usage(100, 30, 180, {"input": 1e-9, "output": 2e-9}, cacheRead=40, cacheWrite=10, reasoning=8), responseModel="real"), entry("e2", usage(-5, 3)), entry("", usage(4)), entry("e3", usage(2, 0, 2, {"total": -1})), entry("e4", usage(2, 0, 2, {"total": 0.0000000001}))])
    put(tmp_path / "b/lost.jsonl", [{"type": "session", "id": "lost", "parentSession": "gone.jsonl"}, entry("k", usage(7))])
    rows, warnings, _ = got(spark, SessionTrees(tmp_path))
    by = {(r["session_id"], r["native_id"]): r for r in rows}
    assert ("child", "shared") not in by and by["parent", "shared"]["input_tokens"] == 100
    assert (by["child", "own"]["input_tokens"], by["child", "own"]["output_tokens"], by["child", "own"]["costs"][0]["usd_nanos"]) == (30, 5, 1_000_000)
    assert (by["child", "sum"]["model"], by["child", "sum"]["input_tokens"]) == ("unknown", 20)
    e1 = by["odd", "e1"]
    assert (e1["input_tokens"], e1["output_tokens"], e1["reasoning_tokens"], e1["cache_read_tokens"], e1["cache_write_tokens"], e1["model"], e1["confidence"]) == (100, 22, 8, 40, 10, "real", "exact")
    assert e1["costs"][0]["usd_nanos"] == 3
    assert (by["odd", "e2"]["input_tokens"], by["odd", "e2"]["confidence"]) == (0, "derived") and by["odd", None]["confidence"] == "derived"
    assert not by["odd", "e3"]["costs"] and not by["odd", "e4"]["costs"] and by["lost", "k"]["confidence"] == "derived"
    assert not any(r["session_id"] == "new" for r in rows)
    text = " ".join(warnings)
    for part in ("newer than version 3", "no readable header precedes", "negative count of input", "has no id", "no readable total", "forked from can't be read"):
        assert part in text


def test_stream_lines(spark, tmp_path):
    def say(u, **more):
        return {"type": "assistant", "message": {"role": "assistant", "content": [], "usage": u}, "parent_tool_use_id": None, "session_id": "s"} | more

    path = put(tmp_path / "s.jsonl", [say({"input_tokens": 120, "output_tokens": 8, "cache_read_input_tokens": 30, "cache_creation_input_tokens": 10}), say({"input_tokens": 99, "output_tokens": 9, "iterations": [{"input_tokens": 1}, {"model": "model-b", "input_tokens": 20, "output_tokens": 4}]}), {"type": "system"}, say({"input_tokens": 5}, parent_tool_use_id="t"), say({}), say({"input_tokens": 1}, session_id=None), "[1]"])
    rows, warnings, _ = got(spark, StreamLines(path))
    assert [(r["input_tokens"], r["output_tokens"], r["cache_read_tokens"], r["cache_write_tokens"], r["model"], r["schema_variant"]) for r in rows] == [(120, 8, 30, 10, "unknown", "amp-stream-json-v1"), (20, 4, 0, 0, "model-b", "amp-stream-json-v1-iterations")]
    assert rows[0]["timestamp_origin"] == "file_modified" and len(warnings) == 3


def test_threads(spark, tmp_path):
    def event(ts, n, mid=None, model="model-a"):
        return {"timestamp": ts, "model": model, "tokens": {"input": n, "output": 2}, "toMessageId": mid, "credits": 1.5}

    def message(n, mid, model="model-a", **more):
        return {"role": "assistant", "messageId": mid, "usage": {"model": model, "inputTokens": n, "outputTokens": 2, **more}}

    (tmp_path / "T-1.json").write_text(json.dumps({"id": "T-1", "created": 1704067200000, "usageLedger": {"events": [event("2024-01-03T00:00:00Z", 10, 1), event("2024-01-02T00:00:00Z", 20, None, "")]}, "messages": [message(11, 1), message(20, None, "unknown"), message(7, 9, "model-b", cacheReadInputTokens=7), {"role": "user"}]}))
    (tmp_path / "T-2.json").write_text("[]")
    (tmp_path / "T-3.json").write_text(json.dumps({"messages": [message(-4, 3), message(0, 4) | {"usage": {"inputTokens": 0}}]}))
    (tmp_path / "other.json").write_text("{}")
    rows, warnings, _ = got(spark, Threads(tmp_path))
    in_order = [(r["source_object_id"], r["occurred_at_unix_ms"], r["event_id"]) for r in Threads(tmp_path).read(spark, Threads(tmp_path).discover()).records.collect()]
    assert in_order == sorted(in_order) and len(in_order) == len(rows)
    one = sorted((r for r in rows if r["session_id"] == "T-1"), key=lambda r: r["occurred_at_unix_ms"])
    assert [(r["input_tokens"], r["model"], r["cache_read_tokens"]) for r in one] == [(7, "model-b", 7), (20, "unknown", 0), (10, "model-a", 0)]
    assert [r["timestamp_origin"] for r in one] == ["derived", "source", "source"]
    three = [r for r in rows if r["session_id"] == "T-3"]
    assert [(r["input_tokens"], r["output_tokens"], r["confidence"], r["timestamp_origin"]) for r in three] == [(0, 2, "derived", "file_modified")]
    text = " ".join(warnings)
    assert "message 1 counts otherwise" in text and "amounts of credit" in text and "[schema]" in text and "negative counts" in text


def meta(id, ts="2024-01-01T00:00:00Z", **more):
    return {"timestamp": ts, "ordinal": 0, "type": "session_meta", "payload": {"id": id, "model_provider": "openai", **more}}


def count(ts, total=None, last=None, ordinal=None):
    u = lambda x: None if x is None else {"input_tokens": x[0], "output_tokens": x[1], "total_tokens": sum(x[:2]), **(x[2] if len(x) > 2 else {})}
    info = {k: v for k, v in (("total_token_usage", u(total)), ("last_token_usage", u(last))) if v}
    return {"timestamp": ts, **({"ordinal": ordinal} if ordinal is not None else {}), "type": "event_msg", "payload": {"type": "token_count", "info": info or None}}


T = "2024-01-01T00:00:{:02d}Z"
TURN = {"timestamp": T.format(1), "type": "turn_context", "payload": {"model": "gpt-synthetic"}}


def rollout(home, name, lines, folder="sessions", tail="", zst=False):
    path = put(home / folder / "2024" / name, lines, tail)
    if zst:
        path.with_name(path.name + ".zst").write_bytes(zstandard.compress(path.read_bytes()))
        path.unlink()
    return path


def test_rollout_counters(spark, tmp_path):
    rollout(tmp_path, "rollout-a.jsonl", [meta("a"), TURN, count(T.format(2), (100, 40)), count(T.format(3), (100, 40)), count(T.format(4), (160, 55)), count(T.format(5), None, (10, 5)), count(T.format(6), (190, 70)), count(T.format(7), (40, 9))])
    rollout(tmp_path, "rollout-b.jsonl", [meta("b", originator="Codex Desktop"), count("no time", None, (50, 20, {"cached_input_tokens": 10, "cache_write_input_tokens": 2, "reasoning_output_tokens": 5}))], zst=True)
    rollout(tmp_path, "rollout-c.jsonl", [meta("c", source="mcp"), count(T.format(2), (5, 5))])
    rollout(tmp_path, "rollout-d.jsonl", [meta("d"), "{bad", count(T.format(2)), count(T.format(3), (0, 0))], tail='{"type"')
    rollout(tmp_path, "rollout-e.jsonl", [meta("e", source={"sub": 1}), count(T.format(2), (5, 5))])
    rollout(tmp_path, "rollout-f.jsonl", [meta("f", source="vscode"), count(T.format(2), None, (3, 1, {"cached_input_tokens": 9}), 7)])
    rows, warnings, ends = got(spark, Rollouts(tmp_path))
    of = lambda k: [r for r in rows if r["session_id"] == k]
    assert [(r["input_tokens"], r["output_tokens"]) for r in of("a")] == [(100, 40), (60, 15), (10, 5), (20, 10), (40, 9)]
    assert {r["model"] for r in of("a")} == {"gpt-synthetic"} and {r["provider"] for r in of("a")} == {"openai"}
    b = of("b")[0]
    assert (b["input_tokens"], b["output_tokens"], b["cache_read_tokens"], b["cache_write_tokens"], b["reasoning_tokens"], b["client"], b["timestamp_origin"]) == (38, 15, 10, 2, 5, "codex-desktop", "file_modified")
    assert not of("c") and not of("d") and not of("e")
    f = of("f")[0]
    assert (f["input_tokens"], f["confidence"], f["client"], f["native_id"]) == (0, "derived", "codex-vscode", "ordinal:7")
    text = Counter(re.sub(r"\d+", "N", w) for w in warnings)
    assert text["a rollout of a service, not of a person: its usage was left out"] == 2 and text["byte N: a counter fell; counting begins anew here"] == 1
    assert sum(n for w, n in text.items() if "a report" in w) == 2 and sum(n for w, n in text.items() if "no end yet" in w) == 1
    assert ends["rollout-d.jsonl"] == (tmp_path / "sessions/2024/rollout-d.jsonl").stat().st_size - len('{"type"')
    rows, _, _ = got(spark, Rollouts(tmp_path), {"rollout-a.jsonl": [r for r in of("a")][3]["record_offset"]})
    assert [(r["input_tokens"], r["output_tokens"]) for r in rows if r["session_id"] == "a"] == [(20, 10), (40, 9)]


def test_rollout_forks_and_pages(spark, tmp_path):
    parent = [meta("p", T.format(0)), count(T.format(2), (100, 20)), count(T.format(9), (500, 20))]
    rollout(tmp_path, "rollout-p.jsonl", parent)
    rollout(tmp_path, "rollout-q.jsonl", [meta("q", T.format(5), forked_from_id="p"), count(T.format(2), (100, 20)), count(T.format(6), (130, 25))])
    rollout(tmp_path, "rollout-r.jsonl", [meta("r", T.format(5), forked_from_id="missing"), count(T.format(6), (9, 1))])
    rollout(tmp_path, "rollout-s.jsonl", [meta("s", T.format(5), forked_from_id="p"), count(T.format(2), (77, 20)), count(T.format(6), (130, 25))])
    name = lambda i: f"rollout-2024-01-01T00-00-00-{UUIDS[i]}.jsonl"
    page = [meta("t", history_mode="paginated"), count(T.format(2), (100, 20), ordinal=1)]
    cut = sum(len(json.dumps(x)) + 1 for x in page)
    base = lambda i, end=cut: {"thread_id": UUIDS[i], "end_ordinal_exclusive": 2, "end_byte_offset": end}
    rollout(tmp_path, name(1), [*page, count(T.format(3), (900, 30), ordinal=2)])
    rollout(tmp_path, name(2), [meta("u", history_mode="paginated", history_base=base(1)), count(T.format(4), (140, 30), ordinal=3)])
    rollout(tmp_path, name(3), [meta("v", history_mode="paginated", history_base=base(3)), count(T.format(4), (140, 30), ordinal=3)])
    rollout(tmp_path, name(4), [meta("w", history_mode="paginated", history_base=base(1, cut - 3)), count(T.format(4), (140, 30), ordinal=3)])
    rows, warnings, _ = got(spark, Rollouts(tmp_path))
    of = lambda k: [(r["input_tokens"], r["output_tokens"], r["confidence"]) for r in rows if r["session_id"] == k]
    assert of("q") == [(30, 5, "exact")]
    assert of("r") == [(9, 1, "derived")]
    assert of("s") == [(77, 20, "derived"), (53, 5, "derived")]
    assert of("u") == [(40, 10, "exact")]
    assert of("v") == [(140, 30, "derived")] and of("w") == [(140, 30, "derived")]
    text = " ".join(warnings)
    assert "was not found" in text and "repeated for 0 reports only" in text and "cycle" in text and "inside a record" in text and len(warnings) == 4


def test_tasks_of_rollouts_dont_grow(spark, tmp_path, monkeypatch):
    """What a task sorts is bounded by rows, whatever the table's size, and has no lines in it: plain, forked and read on."""
    for k in range(40):
        rollout(tmp_path, f"rollout-{k}.jsonl", [meta(f"s{k}", T.format(3), **({"forked_from_id": "s0"} if k % 4 == 1 else {})), TURN, *(count(T.format(n), (k + n, n)) for n in range(2, 9))])
    from tallywheel import tables

    monkeypatch.setattr(tables, "TASK_ROWS", 20)
    batch = Rollouts(tmp_path).read(spark, Rollouts(tmp_path).discover())
    assert batch.records.count() == 7 * 40
    sorted_ones = [t for t in batch.kept if {"latest", "h"} <= set(t.columns)]
    assert len(sorted_ones) == 2
    for table in sorted_ones:
        assert "line" not in table.columns
        rows = [r["count"] for r in table.groupBy(F.input_file_name()).count().collect()]
        assert sum(rows) in (9 * 40, 7 * 40) and max(rows) <= 5 * 9, rows


def test_rollout_discovery(tmp_path):
    for folder, name in (("archived_sessions", "rollout-a.jsonl"), ("sessions", "rollout-a.jsonl.zst"), ("sessions", "rollout-b.jsonl"), ("sessions", "rollout-b.jsonl.zst"), ("archived_sessions", "rollout-c.jsonl.zst")):
        put(tmp_path / folder / name, [])
    found = {c.source_key: c.path.removeprefix(str(tmp_path)) for c in Rollouts(tmp_path).discover()}
    assert found == {"rollout-a.jsonl": "/sessions/rollout-a.jsonl.zst", "rollout-b.jsonl": "/sessions/rollout-b.jsonl", "rollout-c.jsonl": "/archived_sessions/rollout-c.jsonl.zst"}


def test_default_roots():
    env = {"HOME": "/h"}
    assert [str(p) for p in WireJournals.default_roots(env)] == ["/h/.kimi-code", "/h/.kimi"]
    assert [str(p) for p in Rollouts.default_roots({**env, "CODEX_HOME": "~/c"})] == ["/h/c"]
    assert [str(p) for p in SessionTrees.default_roots({**env, "PI_CODING_AGENT_DIR": "/p"})] == ["/p/sessions"]
    assert [str(p) for p in Threads.default_roots({**env, "XDG_DATA_HOME": "/d"})] == ["/d/amp/threads"]


@pytest.mark.parametrize("reader", [WireJournals, SessionTrees, Threads, Rollouts])
def test_nothing_to_discover(reader, tmp_path):
    assert reader(tmp_path / "none").discover() == []


def test_parents_are_no_part_of_a_plan(spark, tmp_path, monkeypatch):
    """Forks find their parents by a join: no plan of a reading grows with the number of files."""
    for k in range(6):
        for name, parent in ((f"p{k}", ""), (f"c{k}", f',"parentSession":"/elsewhere/p{k}.jsonl"')):
            usage = '{"type":"message","id":"n1","message":{"role":"assistant","model":"m","usage":{"input":1,"output":2}}}'
            (tmp_path / f"{name}.jsonl").write_text(f'{{"type":"session","version":3,"id":"{name}"{parent}}}\n{usage}\n{usage.replace("n1", "own") if parent else ""}\n')
    plans, settled = [], readers.settled

    def told(df, *rest):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return settled(df, *rest)

    monkeypatch.setattr(readers, "settled", told)
    reader = readers.SessionTrees(tmp_path)
    batch = reader.read(spark, reader.discover(spark))
    assert sorted((r["session_id"], r["native_id"], r["confidence"]) for r in batch.records.collect()) == sorted([(f"p{k}", "n1", "exact") for k in range(6)] + [(f"c{k}", "own", "exact") for k in range(6)])
    assert plans and not any(f"p{k}.jsonl" in plan for plan in plans for k in range(6))
