"""Every registered query of the usage ledger and its SQL for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallywheel.functions import identity, money, timeutil
from tallywheel.operators import pricing, sequences
from tallywheel.plans import queries as Q
from tallywheel.plans import views as V
from tallywheel.schema import BUCKETS, CONFIDENCE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_SUMS = ", ".join(f"sum({b})::BIGINT AS {b}" for b in BUCKETS)
_TOTAL = "sum(total)::BIGINT AS total_tokens"
_WORST = "CASE max(CASE confidence WHEN 'estimated' THEN 2 WHEN 'derived' THEN 1 ELSE 0 END) WHEN 2 THEN 'estimated' WHEN 1 THEN 'derived' ELSE 'exact' END"
_MONEY = "sum(reported_nanos)::BIGINT AS reported_nanos, sum(estimate_nanos)::BIGINT AS estimate_nanos, sum(unpriced::INT)::BIGINT AS unpriced_events"
_USD = "CASE WHEN {0} IS NULL THEN NULL WHEN {0} % 1000000000 = 0 THEN ({0} // 1000000000)::VARCHAR ELSE ({0} // 1000000000)::VARCHAR || '.' || rtrim(lpad(({0} % 1000000000)::VARCHAR, 9, '0'), '0') END"
_PCT = "CASE WHEN {1} > 0 THEN (({0} * 10000 // {1}) // 100)::VARCHAR || '.' || lpad((({0} * 10000 // {1}) % 100)::VARCHAR, 2, '0') || '%' ELSE 'N/A' END"


def _list(col: str) -> str:
    return f"coalesce(string_agg(DISTINCT nullif({col}, ''), ',' ORDER BY nullif({col}, '')), '')"


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def _with(body: str, *more: str) -> str:
    return "WITH " + ", ".join([V.LEDGER_SQL, *more]) + body


# -- activity

_PERIOD_SQL = {"daily": "day", "weekly": "date_trunc('week', day)::DATE", "monthly": "date_trunc('month', day)::DATE"}


def _activity_sql(granularity: str, dimension: str) -> str:
    return f"SELECT {_PERIOD_SQL[granularity]}::VARCHAR AS period, {dimension} AS series, {_SUMS}, {_TOTAL}, sum(estimate_nanos)::BIGINT AS estimate_nanos, count(*) AS event_count, sum(unpriced::INT)::BIGINT AS unpriced_events FROM facts GROUP BY 1, 2"


for _g in timeutil.PERIODS:
    for _d in Q.DIMENSIONS:
        register(f"activity_{_g}_{_d}", _with(_activity_sql(_g, _d)))(lambda spark, d, g=_g, dim=_d: Q.activity(V.ledger(spark, d), g, dim))

register("daily_usage", _with(f"SELECT day::VARCHAR AS day, client, provider, model, {_SUMS}, count(*) AS event_count FROM facts GROUP BY ALL"))(lambda spark, d: Q.daily_rows(Q.daily_usage(V.usage_events(spark, d))))


@register("daily_merge", ORACLE_SQL["daily_usage"])
def daily_merge(spark, d):
    """The daily projection kept up by deltas: the events of one half, then the other half's added."""
    events = V.usage_events(spark, d)
    early = F.col("occurred_at_unix_ms") % 2 == 0
    return Q.merge_daily(Q.daily_usage(events.filter(early)), Q.daily_usage(events.filter(~early)))


_ACTIVITY = f"activity AS ({_activity_sql('weekly', 'client')})"
_LATEST = "latest AS (SELECT DISTINCT period FROM activity ORDER BY period DESC LIMIT 8)"
register("top_periods", _with("SELECT activity.* FROM activity SEMI JOIN latest USING (period)", _ACTIVITY, _LATEST))(lambda spark, d: Q.last_periods(Q.activity(V.ledger(spark, d), "weekly", "client")))
register("period_totals", _with("SELECT period, sum(total_tokens)::BIGINT AS total, max(sum(total_tokens)::BIGINT) OVER () AS largest FROM activity GROUP BY period", _ACTIVITY))(lambda spark, d: Q.period_totals(Q.activity(V.ledger(spark, d), "weekly", "client")))
register("period_costs", _with("SELECT period, coalesce(sum(estimate_nanos), 0)::BIGINT AS total, max(coalesce(sum(estimate_nanos), 0)::BIGINT) OVER () AS largest FROM activity GROUP BY period", _ACTIVITY))(
    lambda spark, d: Q.period_totals(Q.activity(V.ledger(spark, d), "weekly", "client"), "estimate_nanos")
)

# -- overview, sessions, models

register(
    "overview",
    _with(
        f"SELECT {_SUMS}, {_TOTAL}, count(*) AS event_count, count(DISTINCT day) AS active_days, (SELECT count(*) FROM (SELECT DISTINCT provider, model FROM facts)) AS model_count, "
        "(SELECT count(*) FROM (SELECT DISTINCT source_object_id, session_id FROM facts)) AS session_count, "
        + ", ".join(f"count(*) FILTER (confidence = '{c}') AS {c}_events" for c in CONFIDENCE)
        + ", sum(reported_nanos)::BIGINT AS reported_nanos, sum(estimate_nanos)::BIGINT AS estimate_nanos, sum(credit::INT)::BIGINT AS credit_events, sum(unpriced::INT)::BIGINT AS unpriced_events FROM facts"
    ),
)(lambda spark, d: Q.overview(V.ledger(spark, d)))

register("session_spans", _with("SELECT source_object_id, session_id, min(occurred_at_unix_ms) AS started_at_unix_ms, max(occurred_at_unix_ms) AS ended_at_unix_ms, arg_max(client, (occurred_at_unix_ms, event_id)) AS client FROM usage GROUP BY 1, 2"))(lambda spark, d: Q.session_spans(V.usage_events(spark, d)))

register(
    "session_summaries",
    _with(
        f"SELECT source_object_id, session_id, min(occurred_at_unix_ms) AS started_at_unix_ms, max(occurred_at_unix_ms) AS ended_at_unix_ms, {_SUMS}, {_TOTAL}, count(*) AS event_count, {_WORST} AS confidence, "
        f"{_list('provider')} AS providers, {_list('model')} AS models, {_MONEY}, max(occurred_at_unix_ms) - min(occurred_at_unix_ms) AS duration_ms FROM facts GROUP BY 1, 2"
    ),
)(lambda spark, d: Q.session_summaries(V.ledger(spark, d)))

_MODEL = (
    f"SELECT provider, model, {_list('client')} AS clients, {_SUMS}, {_TOTAL}, count(*) AS event_count, {_WORST} AS confidence, {_MONEY}, {_list('pricing_key')} AS pricing_keys, {_list('pricing_rule')} AS pricing_rules, "
    "max(pricing_confidence) AS pricing_confidence FROM facts GROUP BY 1, 2"
)
register("model_usage", _with(f"SELECT *, {_PCT.format('cache_read_tokens', '(input_tokens + cache_read_tokens)')} AS cache_efficiency FROM m", f"m AS ({_MODEL})"))(lambda spark, d: Q.model_usage(V.ledger(spark, d)))
register("cache_efficiency", _with(f"SELECT provider, model, {_PCT.format('cache_read_tokens', '(input_tokens + cache_read_tokens)')} AS cache_efficiency FROM m", f"m AS ({_MODEL})"))(lambda spark, d: Q.model_usage(V.ledger(spark, d)).select("provider", "model", "cache_efficiency"))
register(
    "token_composition",
    _with(" UNION ALL ".join(f"SELECT '{b}' AS bucket, sum({b})::BIGINT AS tokens, {_PCT.format(f'sum({b})', 'sum(total)')} AS share FROM usage" for b in BUCKETS)),
)(lambda spark, d: Q.token_composition(V.usage_events(spark, d)))
register("confidence_histogram", _with(f"SELECT confidence, count(*) AS event_count, {_TOTAL} FROM usage GROUP BY 1"))(lambda spark, d: Q.confidence_histogram(V.usage_events(spark, d)))

# -- pricing

register("reprice_facts", _with("SELECT source_object_id, event_id, CASE WHEN unpriced THEN 'unpriced' ELSE 'api_equivalent_estimate' END AS kind, estimate_nanos AS usd_nanos, 1::BIGINT AS pricing_snapshot_id, pricing_key, pricing_rule, 'estimated' AS confidence FROM facts"))(
    lambda spark, d: pricing.estimate_facts(V.usage_events(spark, d), pricing.RateDataset(), V.SNAPSHOT)
)
register("reprice_counters", _with("SELECT count(*) FILTER (NOT unpriced) AS priced, count(*) FILTER (unpriced) AS unpriced FROM facts"))(lambda spark, d: pricing.reprice_counters(pricing.estimate_facts(V.usage_events(spark, d), pricing.RateDataset())))
register("unpriced_models", _with(f"SELECT provider, model, count(*) AS event_count, {_TOTAL}, {_list('pricing_rule')} AS rules FROM facts WHERE unpriced GROUP BY 1, 2"))(lambda spark, d: Q.unpriced_models(V.ledger(spark, d)))
@register("rate_card", _with("SELECT r.pricing_key, ri::BIGINT * 1000000 AS input_per_million, ro::BIGINT * 1000000 AS output_per_million, rr::BIGINT * 1000000 AS cache_read_per_million, rw::BIGINT * 1000000 AS cache_write_per_million, rz::BIGINT * 1000000 AS reasoning_per_million, coalesce(a.aliases, '') AS aliases, u.event_count FROM rates r JOIN (SELECT pricing_key, count(*) AS event_count FROM facts WHERE pricing_key IS NOT NULL GROUP BY 1) u USING (pricing_key) LEFT JOIN (SELECT pricing_key, string_agg(name, ',' ORDER BY name) AS aliases FROM rates WHERE pricing_rule <> 'exact' GROUP BY 1) a USING (pricing_key) WHERE r.pricing_rule = 'exact'"))
def rate_card(spark, d):
    """The rates that the events were priced by, with how many of them each priced."""
    used = V.ledger(spark, d).filter("pricing_key IS NOT NULL").groupBy("pricing_key").agg(F.count(F.lit(1)).alias("event_count"))
    return pricing.rate_card(spark, pricing.RateDataset()).join(used, "pricing_key")


def _snapshots(spark):
    return spark.createDataFrame([(1, "reviewed", "2026-08-19.1", "aa", 10), (2, "reviewed", "next", "bb", 20)], "id long, source string, dataset_version string, content_hash string, fetched_at_unix_ms long")


register("pricing_status", _with("SELECT 1::BIGINT AS id, 'reviewed' AS source, '2026-08-19.1' AS dataset_version, 'aa' AS content_hash, 10::BIGINT AS fetched_at_unix_ms, count(*) FILTER (NOT unpriced) AS priced_events, count(*) FILTER (unpriced) AS unpriced_events FROM facts"))(
    lambda spark, d: Q.pricing_status(V.usage_events(spark, d), V.event_costs(spark, d), _snapshots(spark))
)


@register("replace_estimates", _with("SELECT kind, count(*) AS n, sum(usd_nanos)::BIGINT AS usd_nanos FROM (SELECT CASE WHEN unpriced THEN 'unpriced' ELSE 'api_equivalent_estimate' END AS kind, estimate_nanos AS usd_nanos FROM facts UNION ALL SELECT 'provider_reported', reported_nanos FROM facts WHERE reported_nanos IS NOT NULL UNION ALL SELECT 'subscription_credit', NULL FROM facts WHERE credit) GROUP BY 1"))
def replace_estimates(spark, d):
    """Repricing a priced ledger leaves what the sources reported, and one estimate an event."""
    again = pricing.replace_estimates(V.event_costs(spark, d), pricing.estimate_facts(V.usage_events(spark, d), pricing.RateDataset(), 2))
    return again.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("usd_nanos").cast("long").alias("usd_nanos"))


# -- export

register(
    "export_rows",
    _with(
        f"SELECT source_object_id, event_id, session_id, occurred_at_unix_ms, client, nullif(provider, '') AS provider, model, {', '.join(BUCKETS)}, total AS total_tokens, source_reported_total, confidence, "
        f"{_USD.format('reported_nanos')} AS provider_reported_usd, {_USD.format('estimate_nanos')} AS api_equivalent_estimate_usd, unpriced, pricing_key, pricing_rule FROM facts"
    ),
)(lambda spark, d: Q.export_rows(V.ledger(spark, d)))

# -- reconciliation and health

register(
    "source_reconciliation",
    _with(
        f"SELECT *, CASE WHEN checked_events = 0 THEN 'unavailable' WHEN checked_events = event_count AND checked_tokens = source_tokens THEN 'match' WHEN checked_events = event_count THEN 'mismatch' WHEN checked_tokens = source_tokens THEN 'partial_match' ELSE 'partial_mismatch' END AS status FROM "
        f"(SELECT source_object_id, {_SUMS}, {_TOTAL}, count(*) AS event_count, count(*) FILTER (confidence = 'derived') AS derived_events, count(*) FILTER (confidence = 'estimated') AS estimated_events, count(source_reported_total) AS checked_events, sum(total) FILTER (source_reported_total IS NOT NULL)::BIGINT AS checked_tokens, sum(source_reported_total)::BIGINT AS source_tokens FROM usage GROUP BY 1)"
    ),
)(lambda spark, d: Q.source_reconciliation(V.usage_events(spark, d)))

_INST = "installations(id, adapter_id, root_path, enabled, permission_state) AS (SELECT 'inst-' || i, 'adapter-' || (i % 3), '/data/' || i, i <> 3, CASE WHEN i <> 4 THEN 'granted' ELSE 'denied' END FROM range(5) t(i))"
_OBJ = "objects AS (SELECT source_object_id AS id, 'inst-' || (substr(source_object_id, 5)::INT % 4) AS installation_id, max(occurred_at_unix_ms) AS last_scan_unix_ms, CASE WHEN source_object_id <> 'src-6' THEN max(occurred_at_unix_ms) END AS last_success_unix_ms, CASE WHEN source_object_id = 'src-5' THEN '[io] disk' END AS last_error FROM usage GROUP BY 1)"
_RUNS = "runs AS (SELECT o_orderkey AS id, 'src-' || (o_custkey % 7) AS source_object_id, CASE WHEN o_orderkey % 5 = 0 THEN 'replace' ELSE 'append' END AS mode, CASE WHEN o_orderkey % 11 = 0 THEN 'failed' ELSE 'completed' END AS status, (epoch_us(o_orderdate) // 1000)::BIGINT AS finished_unix_ms, o_orderkey % 90 AS inserted, o_orderkey % 3 AS deleted, o_orderkey % 7 AS w, CASE WHEN o_orderkey % 11 = 0 THEN '[parse] bad line' END AS error FROM orders)"
_TOTALS = f"totals AS (SELECT adapter_id, {_SUMS}, count(*) AS event_count, {_TOTAL} FROM usage u JOIN objects o ON u.source_object_id = o.id JOIN installations i ON o.installation_id = i.id GROUP BY 1)"
register("adapter_totals", _with("SELECT * FROM totals", _INST, _OBJ, _TOTALS))(lambda spark, d: Q.adapter_totals(V.usage_events(spark, d), V.objects(spark, d), V.installations(spark)))


@register("cross_check", _with("SELECT adapter_id, 'own' AS reference, total_tokens AS expected_total, total_tokens AS actual_total, 'match' AS status FROM totals UNION ALL SELECT 'adapter-0', 'other', 1, (SELECT total_tokens FROM totals WHERE adapter_id = 'adapter-0'), 'mismatch' UNION ALL SELECT 'adapter-9', 'other', 5, NULL, 'unavailable'", _INST, _OBJ, _TOTALS))
def cross_check(spark, d):
    totals = Q.adapter_totals(V.usage_events(spark, d), V.objects(spark, d), V.installations(spark))
    stated = spark.createDataFrame([("adapter-0", "other", 1), ("adapter-9", "other", 5)], "adapter_id string, reference string, expected_total long")
    return Q.cross_check(totals, totals.select("adapter_id", F.lit("own").alias("reference"), F.col("total_tokens").alias("expected_total")).unionByName(stated))


register("session_sources", _with("SELECT u.source_object_id, session_id, installation_id, adapter_id, o.kind AS source_kind, o.parser_version, count(*) AS event_count FROM usage u JOIN (SELECT *, 'append_only_jsonl' AS kind, 1 AS parser_version FROM objects) o ON u.source_object_id = o.id JOIN installations i ON o.installation_id = i.id WHERE session_id IS NOT NULL GROUP BY ALL", _INST, _OBJ))(
    lambda spark, d: Q.session_sources(Q.session_summaries(V.ledger(spark, d)), V.objects(spark, d).withColumns({"kind": F.lit("append_only_jsonl"), "parser_version": F.lit(1)}), V.installations(spark))
    .select("source_object_id", "session_id", "installation_id", "adapter_id", "source_kind", "parser_version", "event_count")
)

#: Full reads of src-2 end in June of the last year, src-5 never had one; the others' are late enough.
_NOW, _EVERY, _JUNE = 902_100_000_000, 100_000_000, 896_659_200_000
_READ = f"(source_object_id <> 'src-5' OR mode <> 'replace') AND (source_object_id <> 'src-2' OR finished_unix_ms < {_JUNE})"
register("due_sources", _with(f"SELECT adapter_id, o.id AS source_object_id, last_full_unix_ms FROM objects o JOIN installations i ON o.installation_id = i.id AND i.enabled LEFT JOIN (SELECT source_object_id, max(finished_unix_ms) AS last_full_unix_ms FROM runs WHERE status = 'completed' AND mode = 'replace' AND {_READ} GROUP BY 1) r ON r.source_object_id = o.id WHERE last_full_unix_ms IS NULL OR last_full_unix_ms <= {_NOW} - {_EVERY}", _INST, _OBJ, _RUNS))(
    lambda spark, d: Q.due_sources(V.objects(spark, d), V.installations(spark), V.runs(spark, d).filter(_READ), _NOW, _EVERY)
)
_HEALTH = """
SELECT i.adapter_id, i.id AS installation_id, o.id AS source_object_id, state,
       CASE state WHEN 'disabled' THEN 'enable the source' WHEN 'permission_denied' THEN 'grant access to the folder' WHEN 'missing' THEN 'choose the folder again' WHEN 'setup' THEN 'run a first scan'
         WHEN 'unsupported' THEN 'update the reader' WHEN 'error' THEN 'look at the last error' WHEN 'partial' THEN 'look at the warnings' END AS remediation,
       greatest(coalesce(r.inserted, 0) + coalesce(r.deleted, 0), 0)::BIGINT AS records_changed, (coalesce(r.w, 9) < 2)::BIGINT AS warning_count, coalesce(r.error, o.last_error) AS error,
       o.last_scan_unix_ms, o.last_success_unix_ms, e.last_event_unix_ms
FROM (SELECT *, id AS installation_id FROM installations) i LEFT JOIN objects o ON o.installation_id = i.id
LEFT JOIN (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY source_object_id ORDER BY id DESC) = 1) r ON r.source_object_id = o.id
LEFT JOIN (SELECT source_object_id, max(occurred_at_unix_ms) AS last_event_unix_ms FROM usage GROUP BY 1) e ON e.source_object_id = o.id,
LATERAL (SELECT coalesce(r.status = 'failed', false) OR o.last_error IS NOT NULL AS failed) f,
LATERAL (SELECT CASE WHEN NOT i.enabled THEN 'disabled' WHEN i.permission_state = 'denied' THEN 'permission_denied' WHEN o.id IS NULL THEN 'setup' WHEN o.last_success_unix_ms IS NULL AND NOT failed THEN 'setup'
  WHEN r.w = 0 THEN 'unsupported' WHEN failed THEN 'error' WHEN r.w = 1 THEN 'partial' ELSE 'healthy' END AS state) s
"""
register("source_health", _with(_HEALTH, _INST, _OBJ, _RUNS))(lambda spark, d: Q.source_health(V.objects(spark, d), V.installations(spark), V.runs(spark, d), V.usage_events(spark, d)))
register("load_state", _with("SELECT CASE WHEN bool_or(state NOT IN ('healthy', 'disabled')) THEN 'partial' ELSE 'populated' END AS load_state FROM h", _INST, _OBJ, _RUNS, f"h AS ({_HEALTH})"))(
    lambda spark, d: Q.load_state(Q.source_health(V.objects(spark, d), V.installations(spark), V.runs(spark, d), V.usage_events(spark, d)), V.usage_events(spark, d))
)
register("last_run_status", _with("SELECT source_object_id, arg_max(status, id) AS status FROM runs GROUP BY 1", _RUNS))(lambda spark, d: Q.last_runs(V.runs(spark, d)).select("source_object_id", F.col("run.status").alias("status")))
register("last_full_read", _with("SELECT source_object_id, max(finished_unix_ms) AS finished_unix_ms FROM runs WHERE status = 'completed' AND mode = 'replace' GROUP BY 1", _RUNS))(
    lambda spark, d: V.runs(spark, d).filter("status = 'completed' AND mode = 'replace'").groupBy("source_object_id").agg(F.max("finished_unix_ms").alias("finished_unix_ms"))
)
register("event_counts", _with("SELECT source_object_id, count(*) AS event_count, max(occurred_at_unix_ms) AS last_event_unix_ms FROM usage GROUP BY 1"))(lambda spark, d: V.usage_events(spark, d).groupBy("source_object_id").agg(F.count(F.lit(1)).alias("event_count"), F.max("occurred_at_unix_ms").alias("last_event_unix_ms")))
register("cost_facts", _with("SELECT source_object_id, event_id, 'provider_reported' AS kind, reported_nanos AS usd_nanos FROM facts WHERE reported_nanos IS NOT NULL UNION ALL SELECT source_object_id, event_id, 'subscription_credit', NULL FROM facts WHERE credit"))(lambda spark, d: V.source_costs(V.usage_events(spark, d)).select(*Q.KEY, "kind", "usd_nanos"))

# -- sequential operators of the collectors, over the driver's tables


@register("dedup_max_total", "SELECT user_id AS native_id, event_id, total FROM (SELECT user_id, event_id, round(abs(value) * 100)::BIGINT AS total, row_number() OVER (PARTITION BY user_id ORDER BY round(abs(value) * 100)::BIGINT DESC, event_id) AS r FROM events) WHERE r = 1")
def dedup_max_total(spark, d):
    """Of records that share a native id the one with the largest total stays, the first on ties."""
    rows = V._read(spark, d, "events").select(F.col("user_id").alias("native_id"), "event_id", F.round(F.abs("value") * 100).cast("long").alias("total"))
    return sequences.largest_wins(rows, ["native_id"], "total", "event_id")


@register("priority_dedup", "SELECT 'k-' || (event_id % 500) AS source_key, event_id AS path, priority FROM (SELECT *, (event_id % 2) * 2 + (user_id % 2) AS priority, row_number() OVER (PARTITION BY event_id % 500 ORDER BY (event_id % 2) * 2 + (user_id % 2) DESC, event_id) AS r FROM events) WHERE r = 1")
def priority_dedup(spark, d):
    """Of files with one key the highest priority wins (active before archived, plain before compressed), the first on ties."""
    rows = V._read(spark, d, "events").select(F.format_string("k-%d", F.col("event_id") % 500).alias("source_key"), F.col("event_id").alias("path"), ((F.col("event_id") % 2) * 2 + F.col("user_id") % 2).alias("priority"))
    return sequences.largest_wins(rows, ["source_key"], "priority", "path")


@register("carry_forward", "SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN 'model-' || (event_id % 9) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS model FROM events")
def carry_forward(spark, d):
    """The last model named at or before a record holds for it."""
    rows = V._read(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "click", F.format_string("model-%d", F.col("event_id") % 9)).alias("named"))
    return sequences.carried(rows, ["user_id"], "event_id", {"model": "named"}).select("event_id", "model")


@register("byte_offsets", "SELECT user_id, event_id, coalesce(sum(strlen(props) + 1) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS record_offset FROM events")
def byte_offsets(spark, d):
    """Where each record begins in its file."""
    rows = V._read(spark, d, "events").select("user_id", "event_id", F.col("props").alias("line"))
    return sequences.line_offsets(rows, ["user_id"], "event_id").select("user_id", "event_id", "record_offset")


_CUMULATIVE = """
WITH t AS (SELECT user_id, event_id, sum(v) OVER (PARTITION BY user_id, event_id // 700 ORDER BY event_id)::BIGINT AS total FROM (SELECT user_id, event_id, round(abs(value))::BIGINT AS v FROM events)),
p AS (SELECT *, lag(total) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM t WHERE total <> 0)
SELECT user_id, event_id, CASE WHEN before IS NULL OR total < before THEN total ELSE total - before END AS delta, (before IS NOT NULL AND total < before) AS reset
FROM p WHERE total IS DISTINCT FROM before
"""


@register("cumulative_delta", _CUMULATIVE)
def cumulative_delta(spark, d):
    """Running totals to increments: equal totals say nothing, a smaller one is a new start."""
    part = W.partitionBy("user_id", F.floor(F.col("event_id") / 700)).orderBy("event_id")
    rows = V._read(spark, d, "events").select("user_id", "event_id", F.round(F.abs("value")).cast("long").alias("v"))
    rows = rows.select("user_id", "event_id", F.struct(F.sum("v").over(part).alias("total")).alias("total"), F.lit(None).cast("struct<total:bigint>").alias("last"))
    return sequences.increments(rows, ["user_id"], "event_id", ["total"]).filter("emits").select("user_id", "event_id", F.col("delta.total").alias("delta"), "reset")


@register("fork_suppression", "SELECT c.event_id, (p.k IS NOT NULL) AS changed FROM (SELECT event_id, event_id % 4000 AS k, event_type, user_id % 3 AS u FROM events WHERE event_id >= 4000) c LEFT JOIN (SELECT event_id AS k, event_type, user_id % 3 AS u FROM events WHERE event_id < 4000) p ON c.k = p.k WHERE p.k IS NULL OR (c.event_type, c.u) IS DISTINCT FROM (p.event_type, p.u)")
def fork_suppression(spark, d):
    """A child's record that its parent has with the same facts is dropped; with other facts it stays, marked changed."""
    rows = V._read(spark, d, "events").select("event_id", (F.col("event_id") % 4000).alias("k"), F.struct("event_type", (F.col("user_id") % 3).alias("u")).alias("signature"))
    child, parent = rows.filter("event_id >= 4000"), rows.filter("event_id < 4000").select("k", "signature")
    return sequences.without_inherited(child, parent, ["k"]).select("event_id", "changed")


@register("prefix_suppression", "SELECT user_id, event_id FROM (SELECT *, min((expected IS NOT DISTINCT FROM event_type)::INT) OVER (PARTITION BY user_id ORDER BY pos) AS same FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM events) c LEFT JOIN (SELECT row_number() OVER (ORDER BY event_id) AS pos, event_type AS expected FROM events WHERE user_id = 1) p USING (pos)) WHERE same = 0")
def prefix_suppression(spark, d):
    """A child's records are dropped as long as they equal its parent's in order; from the first that differs all stay."""
    rows = V._read(spark, d, "events").select("user_id", "event_id", "event_type")
    parent = rows.filter("user_id = 1").select("event_id", F.col("event_type").alias("expected"), F.lit(1).alias("one"))
    parent = sequences.positions(parent, ["one"], "event_id").select("pos", "expected")
    return sequences.after_common_prefix(sequences.positions(rows, ["user_id"], "event_id"), parent, ["user_id"], "event_type", "expected").select("user_id", "event_id")


@register("as_of_parent", "SELECT c.o_orderkey AS child, max(p.o_orderkey) AS parent FROM orders c LEFT JOIN orders p ON p.o_custkey = c.o_custkey AND p.o_orderdate <= c.o_orderdate AND p.o_orderkey <> c.o_orderkey GROUP BY 1")
def as_of_parent(spark, d):
    """The parent of a fork: same id, begun before the fork, the largest key of those."""
    o = V._read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    child = o.select(F.col("o_orderkey").alias("child"), F.col("o_custkey").alias("id"), F.col("o_orderdate").alias("at"))
    parent = o.select(F.col("o_orderkey").alias("parent"), F.col("o_custkey").alias("id"), F.col("o_orderdate").alias("begun"))
    return sequences.latest_parent(child, parent, "id", "at", "begun", "child", "parent")


@register("identity_conflicts", _with("SELECT a.event_id, ((a.client, a.model, a.occurred_at_unix_ms, a.output_tokens) IS DISTINCT FROM (a.client, a.model, a.occurred_at_unix_ms, a.output_tokens + CASE WHEN a.n % 211 = 0 THEN 1 ELSE 0 END)) AS conflict FROM usage a WHERE a.n % 3 = 0"))
def identity_conflicts(spark, d):
    """Events that a source shows again: the same facts are a duplicate, other facts a conflict."""
    from tallywheel.operators.ledger import compare_again

    events = V.usage_events(spark, d)
    n = F.substring("event_id", 3, 20).cast("long")
    again = events.filter(n % 3 == 0).withColumn("output_tokens", F.col("output_tokens") + F.when(n % 211 == 0, 1).otherwise(0))
    return compare_again(events, again, ("client", "model", "occurred_at_unix_ms", "output_tokens")).select("event_id", "conflict")


# -- scalar functions


@register(
    "scalar_text",
    f"SELECT o_orderkey AS id, {_USD.format('nanos')} AS usd, '$' || ((nanos + 500) // 1000 // 1000000)::VARCHAR || '.' || substr(lpad(((nanos + 500) // 1000 % 1000000)::VARCHAR, 6, '0'), 1, 2) || rtrim(substr(lpad(((nanos + 500) // 1000 % 1000000)::VARCHAR, 6, '0'), 3, 4), '0') AS money, "
    "CASE WHEN o_orderkey * 997 // 60000 < 60 THEN (o_orderkey * 997 // 60000)::VARCHAR || 'm ' || (o_orderkey * 997 // 1000 % 60)::VARCHAR || 's' ELSE (o_orderkey * 997 // 3600000)::VARCHAR || 'h ' || (o_orderkey * 997 // 60000 % 60)::VARCHAR || 'm' END AS duration, "
    "strftime(o_orderdate, '%Y%m%d-%H%M%S') AS compact, format('{:,}', nanos) AS grouped, "
    + _PCT.format("(o_orderkey % 77)", "(o_custkey % 50)")
    + " AS ratio FROM (SELECT o_orderkey, o_custkey, o_orderdate, round(o_totalprice * 100)::BIGINT * 10000 + o_orderkey AS nanos FROM orders)",
)
def scalar_text(spark, d):
    """Money, durations, timestamps, counts and ratios as people read them."""
    o = V._read(spark, d, "orders").withColumn("nanos", F.round(F.col("o_totalprice") * 100).cast("long") * 10_000 + F.col("o_orderkey"))
    return o.select(
        F.col("o_orderkey").alias("id"), money.usd_text(F.col("nanos")).alias("usd"), money.format_usd(F.col("nanos")).alias("money"), timeutil.duration_text(F.col("o_orderkey") * 997).alias("duration"),
        timeutil.compact_text(F.unix_millis(F.col("o_orderdate").cast("timestamp"))).alias("compact"), money.thousands(F.col("nanos")).alias("grouped"), money.ratio_percent(F.col("o_orderkey") % 77, F.col("o_custkey") % 50).alias("ratio"),
    )


@register("identity_hashes", "SELECT event_id, sha256('amp-stream-v1' || chr(0) || user_id || chr(0) || event_id) AS identity FROM events")
def identity_hashes(spark, d):
    """Versioned identities: SHA-256 of parts with a zero byte between them."""
    return V._read(spark, d, "events").select("event_id", identity.sha256_of("amp-stream-v1", F.col("user_id"), F.col("event_id")).alias("identity"))


# -- a larger ledger

_SHIPPED = f"shipped AS (SELECT 'client-' || l_linestatus AS client, CASE l_returnflag WHEN 'A' THEN 'openai' WHEN 'N' THEN 'moonshot' ELSE '' END AS provider, ({V._sql_list(V.MODELS)})[l_partkey % 6 + 1] AS model, l_shipdate::DATE AS day, round(l_quantity * 100)::BIGINT AS input_tokens, round(l_extendedprice)::BIGINT AS output_tokens, round(l_discount * 1000)::BIGINT AS cache_read_tokens, round(l_tax * 1000)::BIGINT AS cache_write_tokens, (l_partkey % 4)::BIGINT AS reasoning_tokens FROM lineitem)"
_SHIPPED_COST = "CASE WHEN a.pricing_key IS NOT NULL THEN (input_tokens * ri + output_tokens * ro + cache_read_tokens * rr + cache_write_tokens * rw + reasoning_tokens * rz)::BIGINT END"


@register("large_activity_monthly", f"WITH {V.LEDGER_SQL}, {_SHIPPED} SELECT date_trunc('month', day)::DATE::VARCHAR AS period, provider AS series, {_SUMS}, sum({' + '.join(BUCKETS)})::BIGINT AS total_tokens, sum({_SHIPPED_COST})::BIGINT AS estimate_nanos, count(*) AS event_count, sum((a.pricing_key IS NULL)::INT)::BIGINT AS unpriced_events FROM shipped s LEFT JOIN rates a ON a.name = s.model GROUP BY 1, 2")
def large_activity_monthly(spark, d):
    """Cost-aware activity of the larger ledger, priced in the same pass over the events."""
    priced = pricing.estimate(V.shipped(spark, d), pricing.RateDataset())
    return Q.activity(priced.withColumns({"estimate_nanos": F.col("usd_nanos"), "unpriced": F.col("kind") == "unpriced"}), "monthly", "provider")


register("large_daily_usage", f"WITH {_SHIPPED} SELECT day::VARCHAR AS day, client, provider, model, {_SUMS}, count(*) AS event_count FROM shipped GROUP BY ALL")(lambda spark, d: Q.daily_usage(V.shipped(spark, d)))
