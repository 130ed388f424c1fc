"""Greedy pairing by ranked joins against the loop that it stands for."""

import random

import pytest

from tallywheel.operators.pairing import greedy_pairs

KIND = "thread string, pos int, first long, second struct<model:string,n:long>"


def loop(askers, takers):
    out = set()
    for thread in {r[0] for r in askers}:
        has, taken = sorted(r for r in takers if r[0] == thread), set()
        for _, pos, first, second in sorted((r for r in askers if r[0] == thread), key=lambda r: r[1]):
            hit = next((t for t in has if t[1] not in taken and first is not None and t[2] == first), None) or next((t for t in has if t[1] not in taken and t[3] == second), None)
            if hit:
                taken.add(hit[1])
                out.add((thread, pos, hit[1]))
    return out


@pytest.mark.parametrize("ids", [2, 6, 100])
def test_pairs_as_one_by_one(spark, ids):
    rng = random.Random(ids)
    side = lambda thread, n: [(thread, i, rng.choice([None, rng.randrange(ids)]), (rng.choice("ab"), rng.randrange(3))) for i in range(n)]
    askers, takers = [], []
    for t in range(40):
        askers += side(f"t{t}", rng.randint(0, 12))
        takers += side(f"t{t}", rng.randint(0, 12))
    got = greedy_pairs(spark.createDataFrame(askers, KIND).repartition(3), spark.createDataFrame(takers, KIND).repartition(2), "thread")
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == loop(askers, [(a, b, c, d) for a, b, c, d in takers])


def test_a_thread_of_distinct_ids_is_ranked(spark):
    """No thread is walked where each message finds its row by its id."""
    askers = [("t", i, i, ("a", i)) for i in range(300)]
    takers = [("t", 299 - i, i, ("a", i)) for i in range(300)]
    got = {(r["asker"], r["taken"]) for r in greedy_pairs(spark.createDataFrame(askers, KIND), spark.createDataFrame(takers, KIND), "thread").collect()}
    assert got == {(i, 299 - i) for i in range(300)}
