"""Greedy pairing of two ordered lists, said as ranked joins: what a reader does one by one, for all groups at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_PAIRS = "array<struct<asker:bigint,taken:bigint>>"


def greedy_pairs(askers: DataFrame, takers: DataFrame, group: str) -> DataFrame:
    """(group, asker, taken): each asker, in order of pos, takes the first free taker of its first key, else of its second.

    Both have group, pos, first (may be null: no key) and second. Askers that find none are not in the result.

    Within a first key the n-th asker takes the n-th taker, and of those left the n-th of a second key takes the n-th: two joins
    by rank. That is what happens one by one, unless an asker may come upon a taker that a later one holds by its first key.
    A group in which that can be is walked in order instead, as an aggregate over its arrays.
    """
    rank = lambda df, *by: df.withColumn("n", F.row_number().over(W.partitionBy(group, *by).orderBy("pos")))
    asks = rank(askers.filter("first IS NOT NULL"), "first").select(group, "first", "n", F.col("pos").alias("asker"))
    has = rank(takers.filter("first IS NOT NULL"), "first").select(group, "first", "n", F.col("pos").alias("taken"), "second")
    by_first = asks.join(has, [group, "first", "n"]).select(group, "asker", "taken", "second")
    rest = askers.join(by_first.select(group, F.col("asker").alias("pos")), [group, "pos"], "left_anti")
    free = takers.join(by_first.select(group, F.col("taken").alias("pos")), [group, "pos"], "left_anti")
    by_second = rank(rest, "second").select(group, "second", "n", F.col("pos").alias("asker")).join(rank(free, "second").select(group, "second", "n", F.col("pos").alias("taken")), [group, "second", "n"])
    held = by_first.groupBy(group, "second").agg(F.max("asker").alias("until"))
    odd = rest.groupBy(group, "second").agg(F.min("pos").alias("from")).join(held, [group, "second"]).filter(F.col("from") < F.col("until")).select(group).distinct()
    ranked = by_first.select(group, "asker", "taken").unionByName(by_second.select(group, "asker", "taken")).join(odd, group, "left_anti")
    return ranked.unionByName(_in_order(askers.join(odd, group, "left_semi"), takers.join(odd, group, "left_semi"), group))


def _in_order(askers: DataFrame, takers: DataFrame, group: str) -> DataFrame:
    """The same, one asker after the other, within one expression a group: for groups that fit in a row, as documents do."""
    row = F.struct("pos", "first", "second")
    both = askers.groupBy(group).agg(F.array_sort(F.collect_list(row)).alias("askers")).join(takers.groupBy(group).agg(F.array_sort(F.collect_list(row)).alias("takers")), group)

    def take(pairs, asker):
        free = F.filter("takers", lambda t: ~F.exists(pairs, lambda p: p.taken.eqNullSafe(t.pos)))
        hit = F.coalesce(F.get(F.filter(free, lambda t: t.first == asker.first), 0), F.get(F.filter(free, lambda t: t.second == asker.second), 0))
        return F.concat(pairs, F.array(F.struct(asker.pos.cast("bigint").alias("asker"), hit.pos.cast("bigint").alias("taken")))).cast(_PAIRS)

    pairs = F.aggregate("askers", F.array().cast(_PAIRS), take)
    return both.select(group, F.explode(pairs).alias("p")).filter("p.taken IS NOT NULL").select(group, "p.asker", "p.taken")
