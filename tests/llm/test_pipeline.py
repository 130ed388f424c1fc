"""The pipeline as it is registered: each stage against a brute-force version of it, over the stage's own input."""

import random
from collections import Counter

import corpus_pipeline
import duckdb
import pandas as pd
import pytest

from tallywheel.llm import decontam, mixing, toxicity
from tests.llm.test_operators import brute_edits, jaccard

INSULTS = ["scumbag", "dimwit", "blockhead", "knucklehead"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    """Documents with insults, copies, benchmark passages and odd rows, their labels and the benchmark."""
    rng = random.Random(31)
    words = ["".join(rng.choices("aeinorstl", k=rng.randint(3, 9))) for _ in range(700)]
    prose = lambda n: rng.choices(words, k=n)
    items = [(i, " ".join(prose(rng.choice([14, 22, 40])))) for i in range(12)] + [(90, None), (91, "")]
    rows, toxic = [], []
    for i in range(420):
        text = prose(rng.randint(30, 90))
        if i % 4 == 0:
            for w in rng.sample(INSULTS, 2):
                text.insert(rng.randrange(len(text)), w)
            toxic.append(i)
        elif i % 21 == 1:
            text[9:9] = items[i % 12][1].split()
        elif i % 21 == 2:
            passage = items[i % 12][1].split()
            passage[3] = "changed"
            text[9:9] = passage
        rows.append((i, " ".join(text)))
    clean = [r for r in rows if r[0] not in toxic and r[0] % 21 not in (1, 2)]
    rows += [(1000 + i, clean[3][1]) for i in range(40)]  # a hot text
    for i in range(40):  # near copies: a word more at an end, one changed inside, one more inside
        text = clean[10 + i][1].split()
        if i % 3 == 0:
            text.append("more")
        else:
            text[len(text) // 2 : len(text) // 2 + i % 3 - 1] = ["other"]
        rows.append((2000 + i, " ".join(text)))
    rows += [(3000, None), (3001, None), (3002, ""), (3003, "one"), (3004, " ".join(prose(30_000))), (None, " ".join(prose(50))), (5, rows[5][1])]
    rows = [(i, t, "en", ["a", "a", "a", "b", None][n % 5], None if t is None else len(t)) for n, (i, t) in enumerate(rows)]
    return rows, [(i, 1, int(i in toxic)) for i in range(420)], items, set(toxic)


def write(spark, folder, rows, labels, items):
    tables = {"documents": (rows, DOCS), "labels": (labels, "doc_id long, quality int, toxic int"), "benchmark": (items, "item_id long, text string")}
    for name, (data, kind) in tables.items():
        spark.createDataFrame(data, kind).write.parquet(f"{folder}/{name}.parquet")


@pytest.fixture(scope="module")
def ran(spark, tmp_path_factory):
    """(input, output) of each stage, as tuples of rows, as run() hands them on."""
    folder, seen = tmp_path_factory.mktemp("pipeline"), []
    rows, labels, items, toxic = corpus()
    write(spark, folder, rows, labels, items)

    def watched(name, stage):
        def inner(spark, docs, sf_dir):
            out = stage(spark, docs, sf_dir)
            seen.append((name, docs.columns, [tuple(r) for r in docs.collect()], out.columns))
            return out

        return name, inner

    before = corpus_pipeline.STAGES
    corpus_pipeline.STAGES = [watched(*s) for s in before]
    try:
        last = corpus_pipeline.run(spark, str(folder))
        end = [tuple(r) for r in last.collect()]
    finally:
        corpus_pipeline.STAGES = before
    after = [s[2] for s in seen[1:]] + [end]
    return {"stages": [(n, c, rows, oc, out) for (n, c, rows, oc), out in zip(seen, after, strict=True)], "items": items, "toxic": toxic, "folder": str(folder), "columns": last.columns}


def stage(ran, at):
    _, _, rows, _, out = ran["stages"][at]
    return rows, out


def keyed(rows):
    return Counter((r[0], r[1]) for r in rows)


def test_stages_and_columns(ran):
    assert [s[0] for s in ran["stages"]] == ["toxicity", "simhash near-dedup", "benchmark decontamination", "mixing to target weights", "sharding"]
    names = [c.split()[0] for c in DOCS.split(", ")]
    assert all(s[1] == names for s in ran["stages"])
    assert all(s[3] == names for s in ran["stages"][:-1]) and ran["columns"] == [*names, "shard", "slot"]


def test_toxic_documents_go(spark, ran):
    rows, out = stage(ran, 0)
    docs = spark.read.parquet(f"{ran['folder']}/documents.parquet")
    said = toxicity.scores(docs, spark.read.parquet(f"{ran['folder']}/labels.parquet")).collect()
    rejected = Counter(r["doc_id"] for r in said if r["score"] >= 0.7)
    assert keyed(rows) - keyed(out) == Counter({k: n for k, n in keyed(rows).items() if k[0] in rejected})
    assert not keyed(out) - keyed(rows)
    assert len(ran["toxic"] & set(rejected)) >= 0.95 * len(ran["toxic"]) and len(set(rejected) - ran["toxic"]) <= 3


def test_one_document_of_each_group_stays(ran):
    rows, out = stage(ran, 1)
    texts = sorted({(r[1] or "").lower() for r in rows})
    words = {t: t.split() for t in texts}
    parent = {t: t for t in texts}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for n, a in enumerate(texts):
        for b in texts[:n]:
            short, long = sorted((len(words[a]), len(words[b])))
            same = words[a] == words[b]
            if same or (short >= 5 and short >= 0.5 * long and jaccard(a, b) >= 0.8):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    groups = {}
    for i, text, *_ in rows:
        groups.setdefault(root((text or "").lower()), []).append(i)
    want = Counter(min((i for i in ids if i is not None), default=None) for ids in groups.values())
    assert Counter(r[0] for r in out) == want
    assert len(want) < len(rows) - 70 and not keyed(out) - keyed(rows)


def test_documents_that_hold_items_go(ran):
    rows, out = stage(ran, 2)
    items = [decontam.words_of(t.encode()) for _, t in ran["items"] if t]
    gone = keyed(rows) - keyed(out)
    holds = {}
    for i, text, *_ in rows:
        words = decontam.words_of((text or "").encode())
        holds[(i, text)] = len(words) < 1000 and any(brute_edits(x, words) <= len(x) // 5 for x in items)
    assert set(gone) == {k for k, held in holds.items() if held} and len(gone) >= 20


def test_mix_takes_what_the_sql_takes(ran):
    rows, out = stage(ran, 3)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=[c.split()[0] for c in DOCS.split(", ")]).astype({"doc_id": "Int64", "n_chars": "Int64"}))
    want = {i: (int(size), int(taken)) for i, size, taken in con.sql(f"SELECT doc_id, size, taken FROM ({mixing.ORACLE}) WHERE size > 0").fetchall()}
    times = Counter(r[0] for r in out if (r[1] or "").split())
    assert len(want) == sum(bool((r[1] or "").split()) for r in rows)
    assert all(times[i] * size == taken for i, (size, taken) in want.items()) and max(times.values()) <= 2


def test_shards_are_even_and_whole(ran):
    rows, out = stage(ran, 4)
    assert keyed(rows) == keyed(out)
    counts = Counter(r[-2] for r in out)
    assert set(counts) <= set(range(16)) and max(counts.values()) - min(counts[s] for s in range(16)) <= 1
    for shard, n in counts.items():
        assert sorted(r[-1] for r in out if r[-2] == shard) == list(range(n))


def test_empty_tables(spark, tmp_path):
    """Without documents nothing comes out; without labels and benchmark nothing is toxic or contaminated."""
    write(spark, tmp_path / "none", [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    rows = [(i, f"text {i} of its own words w{i} x{i} y{i}", "en", "s", None) for i in range(20)]
    write(spark, tmp_path / "some", rows, [], [])
    out = corpus_pipeline.run(spark, str(tmp_path / "some")).collect()
    assert {r["doc_id"] for r in out} == set(range(20)) and len(out) >= 20
