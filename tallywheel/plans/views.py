"""A ledger over the driver's tables: events.parquet stands for usage, lineitem.parquet for a larger ledger.

The same definitions are in SQL (``LEDGER_SQL``), so that every question can be put to another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywheel.operators.pricing import REVIEWED_ALIASES, REVIEWED_RATES, RateDataset, estimate_facts
from tallywheel.plans import queries as Q
from tallywheel.schema import BUCKETS

SNAPSHOT = 1
#: Fixed values of the view: provider and model by user.
PROVIDERS = ("openai", "moonshot", "")
MODELS = ("gpt-5.3-codex", "kimi-k3", "house-model", "gpt-5.6-sol", "kimi-for-coding", "deepseek-chat")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    pick = lambda values, n: F.element_at(F.array(*(F.lit(v) for v in values)), (n % len(values) + 1).cast("int"))
    rows = e.select(
        F.format_string("src-%d", F.col("user_id") % 7).alias("source_object_id"),
        F.format_string("e-%d", F.col("event_id")).alias("event_id"),
        F.format_string("s-%d", F.col("user_id")).alias("session_id"),
        F.col("event_type").alias("client"),
        pick(PROVIDERS, F.col("user_id")).alias("provider"),
        pick(MODELS, F.col("user_id")).alias("model"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("occurred_at_unix_ms"),
        F.round(F.abs("value") * 100).cast("long").alias("input_tokens"),
        F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)).alias("output_tokens"),
        ((F.col("event_id") % 13) * 7).alias("cache_read_tokens"),
        (F.col("event_id") % 5).alias("cache_write_tokens"),
        (F.col("user_id") % 4).alias("reasoning_tokens"),
        F.col("event_id").alias("n"),
    )
    told = Q.total_tokens() + F.when(F.col("n") % 97 == 0, 1).otherwise(0)
    return rows.withColumns({
        "source_reported_total": F.when(F.col("n") % 4 != 0, told),
        "confidence": F.when(F.col("n") % 5 == 0, "derived").when(F.col("n") % 5 == 1, "estimated").otherwise("exact"),
    }).drop("n")


def source_costs(events: DataFrame) -> DataFrame:
    """Cost rows that the sources themselves report, by a rule on the event id."""
    n = F.substring("event_id", 3, 20).cast("long")
    blank = {"pricing_snapshot_id": F.lit(None).cast("long"), "pricing_key": F.lit(None).cast("string"), "pricing_rule": F.lit(None).cast("string"), "confidence": F.lit("exact")}
    reported = events.filter(n % 3 == 0).select(*Q.KEY, F.lit("provider_reported").alias("kind"), ((n % 1000) * 1_000_000).alias("usd_nanos"))
    credit = events.filter(n % 50 == 0).select(*Q.KEY, F.lit("subscription_credit").alias("kind"), F.lit(None).cast("long").alias("usd_nanos"))
    return reported.unionByName(credit).withColumns(blank)


def event_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = usage_events(spark, sf_dir)
    return source_costs(events).unionByName(estimate_facts(events, RateDataset(), SNAPSHOT))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their costs, one row an event."""
    return Q.facts(usage_events(spark, sf_dir), event_costs(spark, sf_dir))


def installations(spark: SparkSession) -> DataFrame:
    rows = [(f"inst-{i}", f"adapter-{i % 3}", f"/data/{i}", i != 3, "granted" if i != 4 else "denied") for i in range(5)]
    return spark.createDataFrame(rows, "id string, adapter_id string, root_path string, enabled boolean, permission_state string")


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources, from the events they own: src-k belongs to installation k mod 4; src-6 has never succeeded."""
    own = usage_events(spark, sf_dir).groupBy(F.col("source_object_id").alias("id")).agg(F.max("occurred_at_unix_ms").alias("last_scan_unix_ms"))
    n = F.substring("id", 5, 9).cast("int")
    return own.select("id", F.format_string("inst-%d", n % 4).alias("installation_id"), "last_scan_unix_ms", F.when(n != 6, F.col("last_scan_unix_ms")).alias("last_success_unix_ms"), F.when(n == 5, "[io] disk").alias("last_error"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read runs, from orders: one a row, dealt to sources."""
    o = _read(spark, sf_dir, "orders")
    n = F.col("o_orderkey")
    status = F.when(n % 11 == 0, "failed").otherwise("completed")
    warnings = F.when(n % 7 == 0, F.array(F.lit("unsupported schema 9"))).when(n % 7 == 1, F.array(F.lit("one line is malformed"))).otherwise(F.array().cast("array<string>"))
    return o.select(
        n.alias("id"), F.format_string("src-%d", F.col("o_custkey") % 7).alias("source_object_id"), F.when(n % 5 == 0, "replace").otherwise("append").alias("mode"), status.alias("status"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("finished_unix_ms"), (n % 100).alias("seen"), (n % 90).alias("inserted"), (n % 9).alias("duplicates"), (n % 3).alias("deleted"),
        warnings.alias("warnings"), F.when(n % 11 == 0, "[parse] bad line").alias("error"),
    )


def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A larger ledger: each line item as one event of usage."""
    li = _read(spark, sf_dir, "lineitem")
    flag = {"A": "openai", "N": "moonshot", "R": ""}
    provider = F.coalesce(*(F.when(F.col("l_returnflag") == k, v) for k, v in flag.items()), F.lit(""))
    return li.select(
        F.format_string("src-%d", F.col("l_suppkey") % 7).alias("source_object_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("event_id"),
        F.format_string("s-%d", F.col("l_orderkey")).alias("session_id"),
        F.concat(F.lit("client-"), "l_linestatus").alias("client"),
        provider.alias("provider"),
        F.element_at(F.array(*(F.lit(m) for m in MODELS)), (F.col("l_partkey") % len(MODELS) + 1).cast("int")).alias("model"),
        F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("occurred_at_unix_ms"),
        F.round(F.col("l_quantity") * 100).cast("long").alias("input_tokens"),
        F.round("l_extendedprice").cast("long").alias("output_tokens"),
        F.round(F.col("l_discount") * 1000).cast("long").alias("cache_read_tokens"),
        F.round(F.col("l_tax") * 1000).cast("long").alias("cache_write_tokens"),
        (F.col("l_partkey") % 4).alias("reasoning_tokens"),
        F.lit(None).cast("long").alias("source_reported_total"),
        F.lit("exact").alias("confidence"),
    )


_TOTAL = " + ".join(BUCKETS)
_sql_list = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
_rate_rows = ", ".join(str((k, k, "exact", *r)) for k, r in REVIEWED_RATES.items()) + ", " + ", ".join(str((a, k, f"alias:{a}", *REVIEWED_RATES[k])) for a, k in REVIEWED_ALIASES.items())

#: The events, rates, costs, and events with costs (``facts``) as common table expressions.
LEDGER_SQL = f"""
usage0 AS (
  SELECT 'src-' || (user_id % 7) AS source_object_id, 'e-' || event_id AS event_id, 's-' || user_id AS session_id, event_type AS client,
         ({_sql_list(PROVIDERS)})[user_id % 3 + 1] AS provider, ({_sql_list(MODELS)})[user_id % 6 + 1] AS model,
         (epoch_us(ts) // 1000)::BIGINT AS occurred_at_unix_ms, round(abs(value) * 100)::BIGINT AS input_tokens,
         coalesce((props->>'$.k')::BIGINT, 0) AS output_tokens, ((event_id % 13) * 7)::BIGINT AS cache_read_tokens,
         (event_id % 5)::BIGINT AS cache_write_tokens, (user_id % 4)::BIGINT AS reasoning_tokens, event_id AS n
  FROM events
), usage AS (
  SELECT * EXCLUDE (n), {_TOTAL} AS total, CASE WHEN n % 4 <> 0 THEN {_TOTAL} + CASE WHEN n % 97 = 0 THEN 1 ELSE 0 END END AS source_reported_total,
         CASE n % 5 WHEN 0 THEN 'derived' WHEN 1 THEN 'estimated' ELSE 'exact' END AS confidence, n
  FROM usage0
), rates(name, pricing_key, pricing_rule, ri, ro, rr, rw, rz) AS (VALUES {_rate_rows}),
matched AS (
  SELECT u.*, coalesce(a.pricing_key, b.pricing_key) AS pricing_key, coalesce(a.pricing_rule, b.pricing_rule, 'unpriced:no-match') AS pricing_rule,
         CASE WHEN coalesce(a.pricing_key, b.pricing_key) IS NOT NULL THEN (input_tokens * coalesce(a.ri, b.ri) + output_tokens * coalesce(a.ro, b.ro)
           + cache_read_tokens * coalesce(a.rr, b.rr) + cache_write_tokens * coalesce(a.rw, b.rw) + reasoning_tokens * coalesce(a.rz, b.rz))::BIGINT END AS estimate_nanos
  FROM usage u LEFT JOIN rates a ON u.provider <> '' AND a.name = u.provider || '/' || u.model LEFT JOIN rates b ON b.name = u.model
), facts AS (
  SELECT *, CASE WHEN n % 3 = 0 THEN (n % 1000) * 1000000 END::BIGINT AS reported_nanos, (estimate_nanos IS NULL) AS unpriced, (n % 50 = 0) AS credit,
         'estimated' AS pricing_confidence,
         CAST(to_timestamp(occurred_at_unix_ms // 1000) AT TIME ZONE 'UTC' AS DATE) AS day
  FROM matched
)
"""
