"""Vector codes, the conversation trie and repeated passages against brute force: nulls, empty and long values, ties, copies, empty tables, odd columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywheel.llm import suffixes, trie, vectorcodes

# -- vector codes


def brute_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """(vec_id, code, error, label_error, sha) by plain loops over all entries."""
    kept = [(i, label, [int(np.floor(scale * float(x))) for x in v]) for i, label, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    d = len(kept[0][2]) // parts
    cut = lambda v: [v[p * d : p * d + d] for p in range(parts)]
    first = sorted((i, v) for i, _, v in kept)[:entries]
    books = [[cut(v)[p] for _, v in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: [min((far(cut(v)[p], e), j) for j, e in enumerate(books[p])) for p in range(parts)]
    for _ in range(rounds):
        found = [near(v) for _, _, v in kept]
        for p in range(parts):
            for j in range(len(books[p])):
                mine = [cut(v)[p] for (_, _, v), f in zip(kept, found, strict=True) if f[p][1] == j]
                if mine:
                    books[p][j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = [near(v) for _, _, v in kept]
    error, total = [sum(f[0] for f in x) for x in found], defaultdict(int)
    for (_, label, _), e in zip(kept, error, strict=True):
        total[label] += e
    sha = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return sorted((i, "".join(f"{j:02x}" for _, j in f), e, total[label], sha) for (i, label, _), f, e in zip(kept, found, error, strict=True))


def some_vectors(seed, n, width=16):
    rng = random.Random(seed)
    value = lambda: rng.choice([0.0, 0.25, -0.25, rng.uniform(-1, 1)])  # noqa: E731  many ties
    rows = [(i, rng.choice([None, 1, 2]), [value() for _ in range(width)]) for i in rng.sample(range(1000), n)]
    rows += [(i + 2000, label, v) for i, label, v in rows[:5]]  # copies
    return rows


@pytest.mark.parametrize("n", [3, 60])
def test_vector_codes(spark, n):
    rows = some_vectors(n, n)
    odd = [(5000, 1, None), (5001, 1, [None] * 16), (5002, 2, [float("nan")] * 16), (5003, None, [float("inf")] * 16)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + odd], "vec_id long, label int, embedding array<float>, codes string, v int").repartition(3)
    rows = [(i, label, None if v is None else [float(np.float32(x)) for x in v]) for i, label, v in rows]
    got = vectorcodes.report(df)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == brute_codes(rows)


def test_partial_distance_search():
    rng = np.random.default_rng(5)
    for d in (1, 2, 7, 8):
        for k in (1, 2, 16):
            x, entries = rng.integers(-4, 5, (300, d)), rng.integers(-4, 5, (k, d))
            full = ((x[:, None] - entries[None]) ** 2).sum(2)
            found, far = vectorcodes.nearest(x, entries)
            assert (found == full.argmin(1)).all() and (far == full.min(1)).all()


def test_vector_codes_of_odd_tables(spark):
    kind = "vec_id long, label string, embedding array<double>"
    assert vectorcodes.report(spark.createDataFrame([], kind)).count() == 0
    assert vectorcodes.report(spark.createDataFrame([(1, "a", None)], kind)).count() == 0
    rows = vectorcodes.report(spark.createDataFrame([(1, "a", []), (2, None, [])], kind)).collect()
    assert [(r["vec_id"], r["code"], r["error"]) for r in rows] == [(1, "0" * 16, 0), (2, "0" * 16, 0)] or len(rows) == 2
    # Lengths differ, huge components, no ids: a defined result.
    rows = vectorcodes.report(spark.createDataFrame([(None, "a", [1e300, -1e300]), (None, "a", [1.0] * 9), (None, "b", [1.0] * 9)], kind)).collect()
    assert len(rows) == 3 and all(r["error"] is not None and len(r["code"]) == 16 for r in rows)


# -- the trie


def brute_trie(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append(((t is not None, t or 0), hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest(), (role, text)))
    own = {c: [x[2] for x in sorted(x, key=lambda x: x[:2])] for c, x in turns.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - int(np.fmod(c, 20)), [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    words = lambda s: len([w for w in "".join(" " if x in " \t\n\r\x0b\x0c" else x for x in s).split(" ") if w])

    def below(node):
        own = (len(members[node]) - 1) * words(node[-1][1]) if node else 0
        parts = [below(x) for x in children[node]]
        return (sum(p[0] for p in parts) if parts else 1, own + sum(p[1] for p in parts))

    out = []
    for node, who in members.items():
        ends = [c for c in who if len(built[c]) == len(node)]
        leaves, saved = below(node)
        out.append((who[0], len(node), members[node[:-1]][0] if node else None, len(who), len(children[node]), leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0], r[1]))


def some_turns(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-60, 300), n):
        for t in range(rng.randint(1, 7)):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None, ""]), rng.choice(["a b", "a  b\tc", "", None, "é x", "a b"])))
    rows += rng.sample(rows, n // 4)  # repeated rows
    rows += [(None, 0, "user", "no id"), (400, 0, "user", "word " * 5000)]
    return rows


KIND = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("cell", [4096, 2])
def test_conversation_trie(spark, monkeypatch, cell):
    monkeypatch.setattr(trie, "CELL", cell)  # with 2 every conversation and path has several cells
    rows = some_turns(cell, 50)
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], KIND + ", depth string, size int, top long").repartition(5)
    got = sorted((tuple(r) for r in trie.prefix_trie(df).collect()), key=lambda r: (r[0], r[1]))
    assert got == brute_trie(rows)


def test_conversation_trie_of_odd_tables(spark):
    assert trie.prefix_trie(spark.createDataFrame([], KIND)).count() == 0
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "a")], KIND)).count() == 0
    one = next(c for c in range(20, 400) if zlib.crc32(str(c).encode()) % 4 and c % 20)  # loses its only turn, and its root is absent
    got = [tuple(r) for r in trie.prefix_trie(spark.createDataFrame([(one, 0, "user", "a")], KIND)).collect()]
    assert got == [(one, 0, None, 1, 0, 1, 0, hashlib.sha256(str(one).encode()).hexdigest())]


def test_ids_that_end_at_a_node_stream_in_order(spark):
    ids = list(range(-5000, 9000))
    df = spark.createDataFrame([(1, 2, 3, i) for i in ids] + [(1, 2, 4, 7)], "depth long, x1 long, x2 long, conv_id long").repartition(7)
    got = {r["x2"]: r["ends_sha256"] for r in trie.chained_hash(df).collect()}
    assert got == {3: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), 4: hashlib.sha256(b"7").hexdigest()}


def test_a_conversation_with_most_rows_is_ranked_over_tasks(spark):
    rows = [(20, i % 977, "user", f"t{i % 7}") for i in range(20_000)] + [(1, 0, "user", "a")]
    got = trie.ranked(spark.createDataFrame(rows, KIND).repartition(4)).filter("conv_id = 20").orderBy("k").collect()
    assert [r["k"] for r in got] == list(range(1, 20_001))
    order = sorted((t, hashlib.md5(f"4:user{x}".encode()).digest()) for _, t, _, x in rows if x != "a")
    assert [bytes(r["digest"]) for r in got] == [d for _, d in order]


# -- repeated passages


def brute_repeats(rows, length):
    count = Counter()
    for _, text in rows:
        b = (text or "").encode()
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for i, text in rows:
        b = (text or "").encode()
        keep = np.ones(len(b), bool)
        for j in range(len(b) - length + 1):
            if count[b[j : j + length]] > 1:
                keep[j : j + length] = False
        left = np.frombuffer(b, np.uint8)[keep].tobytes()
        out.append((i, len(b), len(b) - len(left), len(suffixes.runs_of(~keep)[0]), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def some_passages(seed):
    rng = random.Random(seed)
    fresh = lambda n, of="abcdefghij é": "".join(rng.choices(of, k=n))
    line, passage, base = fresh(30), fresh(70), fresh(400)
    rows = [(i, fresh(rng.randint(0, 200)) + rng.choice(["", line, passage, passage[:41]]) + fresh(rng.randint(0, 100))) for i in range(80)]
    rows += [(100 + i, base[: 20 * i] + fresh(3) + base[20 * i :]) for i in range(10)]
    rows += [(200 + i, rows[3][1]) for i in range(6)] + [(200, rows[3][1])] * 2  # copies and repeated rows
    rows += [(300, None), (301, ""), (302, "a" * 700), (303, "ab" * 300), (None, fresh(300, "ab")), (304, "a" * 39), (305, "a" * 40), (306, fresh(20_000)), (307, (fresh(45) + " ") * 9)]
    return rows


@pytest.mark.parametrize("block", [1 << 20, 2000])
def test_repeated_passages(spark, monkeypatch, block):
    monkeypatch.setattr(suffixes, "PIECE", 500)
    monkeypatch.setattr(suffixes, "MOST_WINDOWS", 64)
    rows = some_passages(block)
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, start int, key string, n long").repartition(4)
    got = suffixes.report(df, length=40, block=block)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_repeats(rows, 40)


def test_repeated_passages_of_odd_tables(spark):
    kind = "doc_id string, text string"
    assert suffixes.report(spark.createDataFrame([], kind)).count() == 0
    got = suffixes.report(spark.createDataFrame([("a", "x"), ("a", None)], kind)).collect()
    assert sorted(r["n_bytes"] for r in got) == [0, 1] and all(r["n_removed"] == 0 for r in got)


def test_run_index():
    rng = random.Random(9)
    for _ in range(150):
        of = rng.choice([b"ab", b"a", b"abc", bytes(range(256))])
        base = bytes(rng.choices(of, k=60))
        strings = list({bytes(rng.choices(of, k=rng.randint(0, 30))) + base[(i := rng.randint(0, 50)) : i + rng.randint(0, 30)] for _ in range(rng.randint(1, 12))})
        index = suffixes.RunIndex(strings)
        assert index.lengths.sum() == len(index.text) and (index.lengths > 0).all()
        found = index.matching_statistics()
        every = [(s, i) for s in range(len(strings)) for i in range(len(strings[s]))]
        for s, i in rng.sample(every, min(20, len(every))):
            mine, best = strings[s][i:], 0
            for t, j in every:
                if (t, j) != (s, i):
                    n = 0
                    for x, y in zip(mine, strings[t][j:], strict=False):
                        if x != y:
                            break
                        n += 1
                    best = max(best, n)
            assert found[index.starts[s] + i] == best


def test_repetitive_strings_have_few_runs():
    rng = random.Random(3)
    base = bytes(rng.choices(b"abcdefgh", k=2000))
    copies = [base[:i] + b"!" + base[i + 1 :] for i in range(0, 2000, 100)]
    index = suffixes.RunIndex(copies)
    assert len(index.chars) < len(index.text) / 5


def test_operators_leave_other_columns_alone(spark):
    """Names that the operators use inside, dotted ones and other cases do no harm."""
    docs = spark.createDataFrame([(1, "a" * 500, 1, 2), (2, "b", 3, 4)], "doc_id long, text string, `a.b` int, runs int").withColumnRenamed("runs", "__runs")
    assert {r["doc_id"]: r["n_removed"] for r in suffixes.report(docs).collect()} == {1: 500, 2: 0}
    turns = spark.createDataFrame([(1, 0, "user", "a", 5)], KIND + ", `x.y` int").withColumn("__cell", F.lit(1))
    assert trie.prefix_trie(turns).count() > 0
