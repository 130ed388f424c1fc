"""Facts over events and costs that were written in buckets: no shuffle of either, the same sums."""

import re

import pytest

from tallywheel.plans import queries as Q
from tallywheel.plans import views as V
from tallywheel.plans.bucketed import ledger_tables

SF = "/root/testdata/sf0.001"


def exchanges(df):
    """The exchanges of a plan, each with the depth at which it stands; and the depth of its join."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda line: len(re.match(r"[ :+\-*()\d]*", line)[0])
    return [depth(x) for x in lines if "Exchange" in x], [depth(x) for x in lines if re.search("SortMergeJoin|ShuffledHashJoin|BroadcastHashJoin", x)]


@pytest.mark.parametrize("question", [lambda f: f, lambda f: Q.session_summaries(f), lambda f: Q.model_usage(f)])
def test_no_exchange_below_the_join(spark, question):
    events, costs = V.usage_events(spark, SF), V.event_costs(spark, SF)
    plain = question(Q.facts(events, costs))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that are too large
    try:
        placed = question(Q.facts(*ledger_tables(events, costs, 4)))
        found, joins = exchanges(placed)
        assert joins and all(x < min(joins) for x in found)
        assert sorted(map(str, placed.collect())) == sorted(map(str, plain.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
