"""Events and costs laid out for joins: bucketed and sorted by (source, event) when they are written, so that no question about
costs shuffles the events again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from tallywheel.plans.queries import KEY
from tallywheel.tables import shared_folder


def bucketed(rows: DataFrame, name: str, buckets: int | None = None) -> DataFrame:
    """rows as a table of its own in the shared folder, in buckets by KEY, each sorted by it. One shuffle, when it is written.

    buckets: the same for tables that are to be joined; as many as Spark shuffles into where none is given. Spark knows the
    table by a name of its own, for as long as the session lives.
    """
    spark = rows.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    out = rows.repartition(n, *KEY).write.bucketBy(n, *KEY).sortBy(*KEY).option("path", f"{shared_folder(spark)}/tallywheel/{table}")
    out.saveAsTable(table)
    return spark.table(table)


def ledger_tables(events: DataFrame, costs: DataFrame, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, costs) in buckets that match: queries.facts() of them joins without an exchange of either."""
    return bucketed(events, "usage_events", buckets), bucketed(costs, "event_costs", buckets)
