"""Chains of parents against a walk from each node."""

import random

import pytest

from tallywheel.operators import lineage

KIND = "child long, parent long, problem string, late string, value long"


def walked(rows):
    link, out = {r[0]: r for r in rows}, {}
    for start in link:
        seen, here, value, problem, cycle = [start], start, None, None, None
        while here in link:
            _, parent, early, late, mine = link[here]
            if early:
                problem = early
            elif parent in seen:
                cycle = parent
            elif late:
                problem = late
            if problem or cycle is not None:
                break
            value = mine if value is None else value
            seen.append(parent)
            here = parent
        out[start] = (problem, value if problem is None and cycle is None else None, cycle)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_chains_resolve_as_a_walk_does(spark, seed):
    rng = random.Random(seed)
    n = 150
    # Chains, trees, rings with tails, links to nobody; problems of both kinds on some.
    parent = {i: rng.choice([None, i - 1, i - 1, i - 1, i - 1, rng.randrange(n), n + 5]) for i in range(n)}
    for ring in ([3], [10, 11, 12], list(range(40, 60))):
        parent |= {i: ring[(k + 1) % len(ring)] for k, i in enumerate(ring)}
    rows = [(i, parent[i], f"p{i}" if rng.random() < 0.04 else None, f"l{i}" if rng.random() < 0.08 or i == 3 else None, i if rng.random() < 0.3 else None) for i in range(n)]
    got = {r["child"]: (r["problem"], r["value"], r["cycle"]) for r in lineage.resolve(spark.createDataFrame(rows, KIND)).collect()}
    assert got == walked(rows)
    assert any(c is not None for _, _, c in got.values())


def test_ancestors(spark):
    parent = {i: (i - 1 if i % 37 else None) for i in range(200)} | {5: 9}  # 5 -> 9 -> 8 -> ... -> 5
    links = spark.createDataFrame(list(parent.items()), "child long, parent long")
    got = {r["node"] for r in lineage.ancestors(links, spark.createDataFrame([(36,), (100,), (999,)], "node long")).collect()}
    want = {999}
    for node in (36, 100):
        while node is not None and node not in want:
            want.add(node)
            node = parent[node]
    assert got == want


def test_no_links(spark):
    assert lineage.resolve(spark.createDataFrame([], KIND)).count() == 0


def test_rounds_grow_with_the_longest_chain(spark, monkeypatch):
    """Many short rings take few rounds, however many links there are."""
    made, settled = [], lineage.settled
    monkeypatch.setattr(lineage, "settled", lambda df, name, *rest: made.append(name) or settled(df, name, *rest))
    rows = [(4 * i + j, 4 * i + (j + 1) % 4 if i % 2 else (4 * i + j - 1 if j else None), None, None, 4 * i + j if j == 0 else None) for i in range(500) for j in range(4)]
    got = {r["child"]: (r["problem"], r["value"], r["cycle"]) for r in lineage.resolve(spark.createDataFrame(rows, KIND)).collect()}
    assert got == walked(rows)
    assert made.count("lineage-rings") <= 4 and made.count("lineage") <= 5
