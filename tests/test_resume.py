"""Reading what was added, with what the reader left to know, against reading the whole file; ranges of bytes against whole files."""

import json
import random

import pytest
import zstandard

from tallywheel.sources import lines as L
from tallywheel.sources.lines import Candidate, read_lines
from tallywheel.sources.readers import SessionTrees, WireJournals
from tallywheel.sources.rollouts import Rollouts
from tests.test_collect import T, UUIDS, count, entry, meta, rollout, usage


@pytest.mark.parametrize("split", [1, 3, 7, 64, 1 << 20])
def test_ranges_hold_every_line_once(spark, tmp_path, monkeypatch, split):
    """Bounds inside lines, inside characters of several bytes, at line ends; blank lines, long lines, no last line end."""
    monkeypatch.setattr(L, "READ", 5)
    rng = random.Random(split)
    texts = {}
    for i in range(6):
        lines = ["".join(rng.choices("aé漢😀 ", k=rng.choice([0, 1, 2, 9, 40]))) for _ in range(12)]
        texts[f"f{i}"] = ("\n".join(lines) + ("\n" if i % 2 else "tail" if i % 3 else "")).encode()
        (tmp_path / f"f{i}").write_bytes(texts[f"f{i}"])
    texts["empty"] = b""
    (tmp_path / "empty").write_bytes(b"")
    found, warnings, ends = read_lines(spark, [Candidate(k, str(tmp_path / k)) for k in texts], split=split)
    got = {}
    for r in found.collect():
        got.setdefault(r["source_key"], []).append((r["record_offset"], r["line"]))
    stops = {r["source_key"]: r["committed_offset"] for r in ends.collect()}
    said = {r["source_key"] for r in warnings.collect()}
    for key, data in texts.items():
        want, at = [], 0
        *lines, tail = data.split(b"\n")
        for line in lines:
            if line.decode().strip(" "):
                want.append((at, line.decode()))
            at += len(line) + 1
        assert sorted(got.get(key, [])) == want and stops[key] == at and (key in said) == bool(tail)


def test_reading_on_starts_at_the_byte(spark, tmp_path):
    path = tmp_path / "f"
    path.write_bytes(b"one\ntwo\nthree\n")
    found, _, ends = read_lines(spark, [Candidate("f", str(path))], {"f": 4}, split=3)
    assert sorted((r["record_offset"], r["line"]) for r in found.collect()) == [(4, "two"), (8, "three")] and ends.first()["committed_offset"] == 14
    found, _, ends = read_lines(spark, [Candidate("f", str(path))], {"f": 14})
    assert found.count() == 0 and ends.first()["committed_offset"] == 14


def test_files_that_fail_alone(spark, tmp_path):
    (tmp_path / "a.zst").write_bytes(zstandard.compress(b"one\ntwo\n")[:-3])
    (tmp_path / "b.zst").write_bytes(zstandard.compress("eins\nzwei é\n".encode()))
    (tmp_path / "c").write_bytes(b"fine\n\xff\xfe\n")
    found, warnings, _ = read_lines(spark, [Candidate(k, str(tmp_path / k)) for k in ("a.zst", "b.zst", "c", "gone")])
    said = {r["source_key"]: r["warning"] for r in warnings.collect()}
    assert said["a.zst"].startswith("[io]") or "no end yet" in said["a.zst"]
    assert said["c"].startswith("[encoding]") and said["gone"].startswith("[io]") and "b.zst" not in said
    assert {r["line"] for r in found.collect() if r["source_key"] == "b.zst"} == {"eins", "zwei é"}


def facts(batch):
    return sorted((str(r.asDict(recursive=True)) for r in batch.records.collect())), sorted((r["source_key"], r["warning"]) for r in batch.warnings.collect())


def grown(spark, reader, files, cuts):
    """Records and warnings of files that grow at the cuts, read on with state each time, and the number of lines read."""
    rows, said, read, offsets, states = [], [], 0, {}, {}
    for step in range(len(next(iter(cuts.values())))):
        for path, lines in files.items():
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text("".join(x + "\n" for x in lines[: cuts[path][step]]), encoding="utf-8")
        batch = reader.read(spark, reader.discover(), {k: v for k, v in offsets.items() if v} or None, {k: v for k, v in states.items() if offsets.get(k)} or None)
        r, w = facts(batch)
        rows, said = rows + r, said + w
        read += batch.kept[0].count()  # the lines of the candidates themselves
        offsets = {x["source_key"]: x["committed_offset"] for x in batch.ends.collect()}
        states = {x["source_key"]: x["state"] for x in batch.states.collect()}
    return rows, said, read


def check(spark, reader, files, seed, steps=4):
    rng = random.Random(seed)
    # The files' time is an event's time where it has none: the same for both ways.
    import os

    cuts = {p: sorted(rng.randint(1, len(x)) for _ in range(steps - 1)) + [len(x)] for p, x in files.items()}
    real = L.stat
    try:
        L.stat = lambda p: (os.path.getsize(p), 10**18) if os.path.isfile(p) else None
        rows, said, read = grown(spark, reader, files, cuts)
        whole = reader.read(spark, reader.discover())
        assert read == sum(map(len, files.values())) and len(rows) > 10
        want, told = facts(whole)
    finally:
        L.stat = real
    assert sorted(rows) == want
    return said, told


@pytest.mark.parametrize("seed", [1])
def test_wire_journals_read_on(spark, tmp_path, seed):
    rng = random.Random(seed)
    files = {}
    for i in (1, 2):
        lines = []
        for n in range(40):
            kind = rng.randrange(5)
            u = {"inputOther": rng.randint(0, 2), "output": n % 3, "inputCacheRead": 0, "inputCacheCreation": 0}
            lines.append("{bad" if kind == 4 and n % 3 == 0 else json.dumps({"type": "llm.request", "model": f"kimi-code/m{n}"}) if kind == 0 else json.dumps({"type": "usage.record", "model": rng.choice(["__x__", "named"]), "usage": u, "time": 1000 + n}))
        files[tmp_path / "sessions" / UUIDS[i] / "wire.jsonl"] = lines
    said, told = check(spark, WireJournals(tmp_path), files, seed)
    assert sorted(said) == told


@pytest.mark.parametrize("seed", [1])
def test_session_trees_read_on(spark, tmp_path, seed):
    rng = random.Random(seed)
    parent = [json.dumps({"type": "session", "version": 3, "id": "p"})] + [json.dumps(entry(f"e{n}", usage(n + 1, 2, n + 3))) for n in range(25)]
    copies = [x if rng.random() < 0.8 else json.dumps(entry(f"e{n}", usage(99, 2))) for n, x in enumerate(parent[1:15])]
    child = [json.dumps({"type": "session", "version": 3, "id": "c", "parentSession": "/x/p.jsonl"}), *copies, *(json.dumps(entry(f"own{n}", usage(n, 5, 1, reasoning=n % 9))) for n in range(20))]
    lost = [json.dumps({"type": "session", "version": 3, "id": "l", "parentSession": "/x/gone.jsonl"})] + [json.dumps(entry(f"k{n}", usage(n + 1))) for n in range(12)]
    files = {tmp_path / "p.jsonl": parent, tmp_path / "c.jsonl": child, tmp_path / "l.jsonl": lost}
    rng_cuts = seed
    # The parent is whole before the child comes, as in life: only then does what was read of it stay true.
    (tmp_path / "p.jsonl").write_text("".join(x + "\n" for x in parent))
    reader = SessionTrees(tmp_path)
    del files[tmp_path / "p.jsonl"]
    import os

    rng = random.Random(rng_cuts)
    cuts = {p: sorted(rng.randint(1, len(x)) for _ in range(2)) + [len(x)] for p, x in files.items()}
    real = L.stat
    try:
        L.stat = lambda p: (os.path.getsize(p), 10**18) if os.path.isfile(p) else None
        rows, _, _ = grown(spark, reader, files, cuts)
        want, _ = facts(reader.read(spark, reader.discover()))
    finally:
        L.stat = real
    mine = [x for x in rows if "pi-v1:session:p:" not in x]
    assert sorted(mine) == [x for x in want if "pi-v1:session:p:" not in x] and len(mine) > 25


@pytest.mark.parametrize("seed", [1, 3])
def test_rollouts_read_on(spark, tmp_path, seed):
    """Counters, models, a fork whose replay ends or breaks between two readings, a page of another rollout."""
    rng = random.Random(seed)

    def reports(n, at=2, base=(0, 0), **more):
        out, i, o = [], *base
        for k in range(n):
            i, o = (i + rng.randint(0, 3), o + rng.randint(0, 2)) if rng.random() < 0.9 else (rng.randint(0, 2), 1)
            out.append(count(T.format(at + k), *rng.choice([((i, o), None), ((i, o), (1, 1)), (None, (2, 1))]), **more))
        return out

    parent = [meta("p", T.format(0)), *reports(12)]
    rollout(tmp_path, "rollout-p.jsonl", parent)
    page = [meta("t", history_mode="paginated"), *[{**x, "ordinal": k + 1} for k, x in enumerate(reports(6))]]
    cut = sum(len(json.dumps(x)) + 1 for x in page)
    name = lambda i: f"rollout-2024-01-01T00-00-00-{UUIDS[i]}.jsonl"
    rollout(tmp_path, name(1), page)
    broken = rng.randint(2, 9)
    replayed = parent[1:9]
    apart = [*parent[1:broken], count(T.format(30), (77, 7)), *parent[broken + 1 : 9]]
    base = {"thread_id": UUIDS[1], "end_ordinal_exclusive": 99, "end_byte_offset": cut}
    turn = lambda k: {"timestamp": T.format(40), "type": "turn_context", "payload": {"model": f"m{k}"}}
    files = {
        "rollout-q.jsonl": [meta("q", T.format(9), forked_from_id="p"), *replayed, turn(1), *reports(9, 31, (60, 60))],
        "rollout-s.jsonl": [meta("s", T.format(9), forked_from_id="p"), *apart, turn(2), *reports(9, 31, (60, 60))],
        "rollout-r.jsonl": [meta("r", T.format(9), forked_from_id="missing"), *reports(14)],
        name(2): [meta("u", history_mode="paginated", history_base=base), *reports(8, 20, (50, 50), ordinal=50)],
        "rollout-v.jsonl": [meta("v", source="mcp"), *reports(5)],
        "rollout-w.jsonl": [turn(3), *reports(6), meta("w"), turn(4), *reports(6)],
    }
    files = {tmp_path / "sessions/2024" / k: [json.dumps(x) for x in v] for k, v in files.items()}
    import os

    reader = Rollouts(tmp_path)
    first = {p: x for p, x in files.items()}
    cuts = {p: sorted(rng.randint(1, len(x)) for _ in range(2)) + [len(x)] for p, x in first.items()}
    real = L.stat
    try:
        L.stat = lambda p: (os.path.getsize(p), 10**18) if os.path.isfile(p) else None
        rows, said, _ = grown(spark, reader, first, cuts)
        want, told = facts(reader.read(spark, reader.discover()))
    finally:
        L.stat = real
    assert sorted(rows) == want and len(rows) > 30
    assert sorted(said) == told
