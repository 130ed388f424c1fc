"""The analytic questions over a ledger: events, costs, and the tables of sources and runs, all as DataFrames.

Costs are brought to one row an event before they meet events, so that an event with several cost rows counts once.
Every result is a plain plan: one aggregation over the events, joined to small tables where a question needs them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywheel.functions import timeutil
from tallywheel.functions.money import add_exact, ratio_percent, usd_text
from tallywheel.schema import BUCKETS, CONFIDENCE, CREDIT, ESTIMATE, REPORTED, UNPRICED

KEY = ["source_object_id", "event_id"]
DIMENSIONS = {"client": ["client"], "provider": ["provider"], "model": ["model"]}


def total_tokens() -> Column:
    return sum((F.col(b) for b in BUCKETS[1:]), F.col(BUCKETS[0]))


def bucket_sums() -> list[Column]:
    return [F.sum(b).cast("long").alias(b) for b in BUCKETS]


def total_of_sums() -> Column:
    return F.sum(total_tokens()).cast("long").alias("total_tokens")


def confidence_rank(name: str = "confidence") -> Column:
    return F.coalesce(*(F.when(F.col(name) == c, i) for i, c in enumerate(CONFIDENCE)))


def worst(name: str = "confidence") -> Column:
    """The worst confidence of a group; null for a group without any."""
    return F.get(F.array(*(F.lit(c) for c in CONFIDENCE)), F.max(confidence_rank(name)))


def listed(column: str | Column) -> Column:
    """The distinct non-empty values of a group in order, as text."""
    col = F.col(column) if isinstance(column, str) else column
    return F.array_join(F.sort_array(F.collect_set(F.nullif(col, F.lit("")))), ",")


def facts(events: DataFrame, costs: DataFrame) -> DataFrame:
    """events with reported_nanos, estimate_nanos, unpriced, credit, pricing_key, pricing_rule, pricing_confidence: one row an event."""
    kind = F.col("kind")
    of = lambda k, c: F.max(F.when(kind == k, F.col(c)))
    one = costs.groupBy(*KEY).agg(
        of(REPORTED, "usd_nanos").alias("reported_nanos"),
        of(ESTIMATE, "usd_nanos").alias("estimate_nanos"),
        F.max(kind == UNPRICED).alias("unpriced"),
        F.max(kind == CREDIT).alias("credit"),
        F.max(F.when(kind.isin(ESTIMATE, UNPRICED), F.col("pricing_key"))).alias("pricing_key"),
        F.max(F.when(kind.isin(ESTIMATE, UNPRICED), F.col("pricing_rule"))).alias("pricing_rule"),
        F.max(F.when(kind.isin(ESTIMATE, UNPRICED), F.col("confidence"))).alias("pricing_confidence"),
    )
    return events.join(one, KEY, "left").withColumns({"unpriced": F.coalesce("unpriced", F.lit(False)), "credit": F.coalesce("credit", F.lit(False))})


def money_sums() -> list[Column]:
    return [
        F.sum("reported_nanos").cast("long").alias("reported_nanos"),
        F.sum("estimate_nanos").cast("long").alias("estimate_nanos"),
        F.sum(F.col("unpriced").cast("long")).alias("unpriced_events"),
    ]


def daily_usage(events: DataFrame) -> DataFrame:
    """(day, client, provider, model): bucket sums and event count."""
    keys = [timeutil.day(F.col("occurred_at_unix_ms")).cast("string").alias("day"), "client", "provider", "model"]
    return events.groupBy(*keys).agg(*bucket_sums(), F.count(F.lit(1)).alias("event_count"))


def merge_daily(existing: DataFrame, delta: DataFrame) -> DataFrame:
    """Daily rows with those of new events added."""
    both = existing.unionByName(delta)
    return both.groupBy("day", "client", "provider", "model").agg(*bucket_sums(), F.sum("event_count").alias("event_count"))


def daily_rows(rows: DataFrame) -> DataFrame:
    """Daily rows as they are read: by day, client, provider and model. The stored projection itself has no order."""
    return rows.orderBy("day", "client", "provider", "model")


def activity(facts_: DataFrame, granularity: str, dimension: str) -> DataFrame:
    """(period, series), in that order: tokens, estimated cost (null if none), events and unpriced events. A sum beyond a long
    is an error."""
    period = timeutil.PERIODS[granularity](F.col("occurred_at_unix_ms")).cast("string")
    return facts_.groupBy(period.alias("period"), F.col(dimension).alias("series")).agg(*bucket_sums(), total_of_sums(), F.sum("estimate_nanos").cast("long").alias("estimate_nanos"), F.count(F.lit(1)).alias("event_count"), F.sum(F.col("unpriced").cast("long")).alias("unpriced_events")).orderBy("period", "series")


def last_periods(activity_rows: DataFrame, most: int = 8) -> DataFrame:
    """The rows of the latest periods (a chart's window), the earliest of them first; it reads only the distinct periods to find them."""
    latest = activity_rows.select("period").distinct().orderBy(F.desc("period")).limit(most)
    return activity_rows.join(F.broadcast(latest), "period", "left_semi").orderBy("period", "series")


def period_totals(activity_rows: DataFrame, metric: str = "total_tokens") -> DataFrame:
    """Each period's total of a metric, and the largest of them (a chart's scale), by period."""
    totals = activity_rows.groupBy("period").agg(F.coalesce(F.sum(metric), F.lit(0)).cast("long").alias("total"))
    return totals.join(F.broadcast(totals.agg(F.max("total").alias("largest")))).orderBy("period")


def overview(facts_: DataFrame) -> DataFrame:
    """One row: the lifetime of the ledger."""
    ms = F.col("occurred_at_unix_ms")
    count_of = lambda c: F.coalesce(F.sum(F.when(F.col("confidence") == c, 1)), F.lit(0)).alias(f"{c}_events")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return facts_.agg(
        *(zero(b).alias(b) for b in BUCKETS),
        zero(total_tokens()).alias("total_tokens"),
        F.count(F.lit(1)).alias("event_count"),
        F.countDistinct(timeutil.day(ms)).alias("active_days"),
        F.countDistinct("provider", "model").alias("model_count"),
        F.countDistinct("source_object_id", "session_id").alias("session_count"),
        *(count_of(c) for c in CONFIDENCE),
        F.sum("reported_nanos").cast("long").alias("reported_nanos"),
        F.sum("estimate_nanos").cast("long").alias("estimate_nanos"),
        zero(F.col("credit").cast("long")).alias("credit_events"),
        zero(F.col("unpriced").cast("long")).alias("unpriced_events"),
    )


def session_spans(events: DataFrame) -> DataFrame:
    """(source, session): first and last event, and the client that wrote last."""
    rows = events.filter(F.col("session_id").isNotNull())
    last = F.max_by("client", F.struct("occurred_at_unix_ms", "event_id"))
    return rows.groupBy("source_object_id", "session_id").agg(F.min("occurred_at_unix_ms").alias("started_at_unix_ms"), F.max("occurred_at_unix_ms").alias("ended_at_unix_ms"), last.alias("client"))


def session_parts(events: DataFrame) -> DataFrame:
    """(source, session): first and last event with the last one's id and client: what merged_sessions() can merge."""
    rows = events.filter(F.col("session_id").isNotNull())
    last = F.max(F.struct("occurred_at_unix_ms", "event_id", "client")).alias("last")
    return rows.groupBy("source_object_id", "session_id").agg(F.min("occurred_at_unix_ms").alias("started_unix_ms"), last).select("source_object_id", "session_id", "started_unix_ms", F.col("last.occurred_at_unix_ms").alias("ended_unix_ms"), F.col("last.event_id").alias("last_event_id"), F.col("last.client").alias("client"))


def merged_sessions(parts: DataFrame) -> DataFrame:
    """One row a (source, session) of several parts."""
    last = F.max(F.struct("ended_unix_ms", "last_event_id", "client")).alias("last")
    return parts.groupBy("source_object_id", "session_id").agg(F.min("started_unix_ms").alias("started_unix_ms"), last).select("source_object_id", "session_id", "started_unix_ms", "last.ended_unix_ms", "last.last_event_id", "last.client")


def session_summaries(facts_: DataFrame) -> DataFrame:
    """(source, session), the last ended first: sums, worst confidence, providers, models, costs and span."""
    rows = facts_.filter(F.col("session_id").isNotNull())
    out = rows.groupBy("source_object_id", "session_id").agg(
        F.min("occurred_at_unix_ms").alias("started_at_unix_ms"),
        F.max("occurred_at_unix_ms").alias("ended_at_unix_ms"),
        *bucket_sums(),
        total_of_sums(),
        F.count(F.lit(1)).alias("event_count"),
        worst().alias("confidence"),
        listed("provider").alias("providers"),
        listed("model").alias("models"),
        *money_sums(),
    )
    return out.withColumn("duration_ms", F.col("ended_at_unix_ms") - F.col("started_at_unix_ms")).orderBy(F.desc("ended_at_unix_ms"), "source_object_id", "session_id")


def session_sources(summaries: DataFrame, objects: DataFrame, installations: DataFrame) -> DataFrame:
    """session_summaries() with each session's installation, adapter, and its source's kind and parser; the same order."""
    named = objects.select(F.col("id").alias("source_object_id"), "installation_id", F.col("kind").alias("source_kind"), "parser_version")
    named = named.join(installations.select(F.col("id").alias("installation_id"), "adapter_id"), "installation_id")
    return summaries.join(named, "source_object_id").orderBy(F.desc("ended_at_unix_ms"), "source_object_id", "session_id")


def report_sources(events: DataFrame, objects: DataFrame, installations: DataFrame) -> DataFrame:
    """source_reconciliation() of every known source, with its adapter, parser and last success; one without events has zeros."""
    named = objects.select(F.col("id").alias("source_object_id"), "installation_id", "parser_version", "last_success_unix_ms")
    named = named.join(installations.select(F.col("id").alias("installation_id"), "adapter_id"), "installation_id").drop("installation_id")
    out = named.join(source_reconciliation(events), "source_object_id", "left")
    sums = [c for c in out.columns if c not in (*named.columns, "status", "checked_tokens", "source_tokens")]
    return out.fillna(0, sums).fillna("unavailable", ["status"]).orderBy("adapter_id", "source_object_id")


def model_usage(facts_: DataFrame) -> DataFrame:
    """(provider, model), most tokens first: clients, sums, costs, pricing keys and rules, cache efficiency, share of all tokens."""
    read, fresh = F.col("cache_read_tokens").cast("decimal(38,0)"), F.col("input_tokens").cast("decimal(38,0)")
    out = facts_.groupBy("provider", "model").agg(
        listed("client").alias("clients"),
        *bucket_sums(),
        total_of_sums(),
        F.count(F.lit(1)).alias("event_count"),
        worst().alias("confidence"),
        *money_sums(),
        listed("pricing_key").alias("pricing_keys"),
        listed("pricing_rule").alias("pricing_rules"),
        worst("pricing_confidence").alias("pricing_confidence"),
    )
    return out.withColumn("cache_efficiency", ratio_percent(read, read + fresh)).orderBy(F.desc("total_tokens"), "provider", "model")


def token_composition(events: DataFrame) -> DataFrame:
    """(bucket, tokens, share): how the tokens of the ledger divide into buckets."""
    sums = events.agg(*bucket_sums(), total_of_sums())
    pairs = F.array(*(F.struct(F.lit(b).alias("bucket"), F.coalesce(F.col(b), F.lit(0)).cast("long").alias("tokens")) for b in BUCKETS))
    rows = sums.select(F.explode(pairs).alias("p"), F.coalesce("total_tokens", F.lit(0)).alias("t"))
    return rows.select("p.bucket", "p.tokens", ratio_percent(F.col("p.tokens"), F.col("t")).alias("share"))


def confidence_histogram(events: DataFrame) -> DataFrame:
    return events.groupBy("confidence").agg(F.count(F.lit(1)).alias("event_count"), total_of_sums())


def pricing_status(events: DataFrame, costs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """At most one row: the snapshot in use and what it prices. With events, the newest one that a cost names; without, the newest fetched."""
    counts = costs.agg(F.max("pricing_snapshot_id").alias("used")).join(events.limit(1).agg((F.count(F.lit(1)) > 0).alias("any")))
    newest = snapshots.agg(F.max_by("id", F.struct("fetched_at_unix_ms", "id")).alias("newest"))
    chosen = counts.join(newest).select(F.when(F.col("any"), F.col("used")).otherwise(F.col("newest")).alias("id"))
    mine = costs.join(F.broadcast(chosen.withColumnRenamed("id", "pricing_snapshot_id")), "pricing_snapshot_id", "left_semi")
    tally = mine.agg(F.coalesce(F.sum(F.when(F.col("kind") == ESTIMATE, 1)), F.lit(0)).alias("priced_events"), F.coalesce(F.sum(F.when(F.col("kind") == UNPRICED, 1)), F.lit(0)).alias("unpriced_events"))
    return snapshots.join(F.broadcast(chosen), "id", "left_semi").select("id", "source", "dataset_version", "content_hash", "fetched_at_unix_ms").join(tally)


def needs_repricing(status: DataFrame, events: DataFrame, source: str, version: str, content_hash: str) -> bool:
    """Whether the ledger's estimates are another dataset's, or don't cover every event."""
    row = status.first()
    if row is None:
        return True
    same = (row["source"], row["dataset_version"], row["content_hash"]) == (source, version, content_hash)
    return not same or row["priced_events"] + row["unpriced_events"] != events.count()


def unpriced_models(facts_: DataFrame) -> DataFrame:
    rows = facts_.filter("unpriced")
    return rows.groupBy("provider", "model").agg(F.count(F.lit(1)).alias("event_count"), total_of_sums(), listed("pricing_rule").alias("rules"))


EXPORT_COLUMNS = (
    "event_id", "session_id", "occurred_at_unix_ms", "client", "provider", "model", *BUCKETS, "total_tokens", "source_reported_total", "confidence",
    "provider_reported_usd", "api_equivalent_estimate_usd", "unpriced", "pricing_key", "pricing_rule",
)


def export_rows(facts_: DataFrame) -> DataFrame:
    """The export's columns and the source (for order only): no paths, notes, warnings or content."""
    values = {
        "provider": F.nullif("provider", F.lit("")),
        "total_tokens": total_tokens(),
        "provider_reported_usd": usd_text(F.col("reported_nanos")),
        "api_equivalent_estimate_usd": usd_text(F.col("estimate_nanos")),
    }
    return facts_.withColumns(values).select("source_object_id", *EXPORT_COLUMNS)


def source_reconciliation(events: DataFrame) -> DataFrame:
    """Per source: canonical sums, what the source itself reported, and whether they agree."""
    told = F.col("source_reported_total").isNotNull()
    out = events.groupBy("source_object_id").agg(
        *bucket_sums(),
        total_of_sums(),
        F.count(F.lit(1)).alias("event_count"),
        F.sum(F.when(F.col("confidence") == "derived", 1).otherwise(0)).alias("derived_events"),
        F.sum(F.when(F.col("confidence") == "estimated", 1).otherwise(0)).alias("estimated_events"),
        F.sum(told.cast("long")).alias("checked_events"),
        F.sum(F.when(told, total_tokens())).cast("long").alias("checked_tokens"),
        F.sum("source_reported_total").cast("long").alias("source_tokens"),
    )
    full, equal = F.col("checked_events") == F.col("event_count"), F.col("checked_tokens") == F.col("source_tokens")
    status = F.when(F.col("checked_events") == 0, "unavailable").when(full & equal, "match").when(full, "mismatch").when(equal, "partial_match").otherwise("partial_mismatch")
    return out.withColumn("status", status).orderBy("source_object_id")


def adapter_totals(events: DataFrame, objects: DataFrame, installations: DataFrame) -> DataFrame:
    """Bucket sums by adapter, with a total beyond an unsigned 64-bit count as null."""
    named = objects.select(F.col("id").alias("source_object_id"), "installation_id").join(installations.select(F.col("id").alias("installation_id"), "adapter_id"), "installation_id")
    out = events.join(named, "source_object_id").groupBy("adapter_id").agg(*bucket_sums(), F.count(F.lit(1)).alias("event_count"))
    return out.withColumn("total_tokens", add_exact(*(F.col(b) for b in BUCKETS)).cast("long"))


def cross_check(totals: DataFrame, expectations: DataFrame, references: Sequence[str] = ()) -> DataFrame:
    """expectations (adapter_id, reference, expected_total) against adapter totals: match, mismatch or unavailable.

    By adapter, then by the place of the reference in `references`; those not named there come last, by name.
    """
    out = expectations.join(totals.select("adapter_id", F.col("total_tokens").alias("actual_total")), "adapter_id", "left")
    status = F.when(F.col("expected_total").isNull() | F.col("actual_total").isNull(), "unavailable").when(F.col("expected_total") == F.col("actual_total"), "match").otherwise("mismatch")
    place = F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(r) for r in references)).cast("array<string>"), F.col("reference")), F.lit(0)), F.lit(len(references) + 1))
    return out.select("adapter_id", "reference", "expected_total", "actual_total", status.alias("status")).orderBy("adapter_id", place, "reference")


def due_sources(objects: DataFrame, installations: DataFrame, runs: DataFrame, now_ms: int, interval_ms: int) -> DataFrame:
    """Sources of enabled installations whose last completed full read is older than the interval, or that never had one."""
    full = runs.filter("status = 'completed' AND mode = 'replace'").groupBy("source_object_id").agg(F.max("finished_unix_ms").alias("last_full_unix_ms"))
    mine = installations.filter("enabled").select(F.col("id").alias("installation_id"), "adapter_id")
    rows = objects.withColumnRenamed("id", "source_object_id").join(mine, "installation_id").join(full, "source_object_id", "left")
    return rows.filter(F.col("last_full_unix_ms").isNull() | (F.col("last_full_unix_ms") <= now_ms - interval_ms)).select("adapter_id", "source_object_id", "last_full_unix_ms").orderBy("adapter_id", "source_object_id")


def last_runs(runs: DataFrame) -> DataFrame:
    """The newest run of each source."""
    run = F.struct(*(c for c in runs.columns if c != "source_object_id"))
    return runs.groupBy("source_object_id").agg(F.max_by(run, "id").alias("run"))


def unsupported(warning: Column) -> Column:
    low = F.lower(warning)
    return (low.contains("unsupported") & low.contains("schema")) | low.contains("newer than version")


def source_health(objects: DataFrame, installations: DataFrame, runs: DataFrame, events: DataFrame) -> DataFrame:
    """Every installation and source with its state, what changed last, its error and what to do about it."""
    mine = installations.select(F.col("id").alias("installation_id"), "adapter_id", "enabled", "permission_state")
    own = objects.select(F.col("id").alias("source_object_id"), "installation_id", "last_scan_unix_ms", "last_success_unix_ms", "last_error")
    last = events.groupBy("source_object_id").agg(F.max("occurred_at_unix_ms").alias("last_event_unix_ms"))
    rows = mine.join(own, "installation_id", "left").join(last_runs(runs), "source_object_id", "left").join(last, "source_object_id", "left")
    warnings = F.coalesce("run.warnings", F.array().cast("array<string>"))
    failed = F.coalesce(F.col("run.status") == "failed", F.lit(False)) | F.col("last_error").isNotNull()
    kind = F.regexp_extract(F.coalesce("run.error", "last_error"), r"^\[([a-z_]+)\]", 1)
    state = (
        F.when(~F.col("enabled"), "disabled")
        .when(F.col("permission_state") == "denied", "permission_denied")
        .when(F.col("permission_state") == "missing", "missing")
        .when(F.col("permission_state") == "unknown", "setup")
        .when(F.col("source_object_id").isNull(), "setup")
        .when(F.col("last_success_unix_ms").isNull() & ~failed, "setup")
        .when(F.exists(warnings, unsupported) | (kind == "unsupported_schema"), "unsupported")
        .when(failed, "error")
        .when(F.size(warnings) > 0, "partial")
        .otherwise("healthy")
    )
    remedy = (
        F.when(state == "disabled", "enable the source")
        .when(state == "permission_denied", "grant access to the folder")
        .when(state == "missing", "choose the folder again")
        .when(state == "setup", "run a first scan")
        .when(state == "unsupported", "update the reader")
        .when(state == "error", "look at the last error")
        .when(state == "partial", "look at the warnings")
    )
    changed = F.greatest(F.coalesce("run.inserted", F.lit(0)) + F.coalesce("run.deleted", F.lit(0)), F.lit(0)).cast("long")
    return rows.select(
        "adapter_id", "installation_id", "source_object_id", state.alias("state"), remedy.alias("remediation"), changed.alias("records_changed"),
        F.size(warnings).cast("long").alias("warning_count"), F.coalesce("run.error", "last_error").alias("error"), "last_scan_unix_ms", "last_success_unix_ms", "last_event_unix_ms",
    ).orderBy("adapter_id", "installation_id", F.asc_nulls_first("source_object_id"))


def load_state(health: DataFrame, events: DataFrame) -> DataFrame:
    """One row: partial if a source needs attention, empty without events, else populated."""
    bad = health.agg(F.coalesce(F.max(F.col("state").isin("partial", "setup", "unsupported", "error", "permission_denied", "missing")), F.lit(False)).alias("bad"))
    some = events.limit(1).agg((F.count(F.lit(1)) > 0).alias("some"))
    return bad.join(some).select(F.when(F.col("bad"), "partial").when(~F.col("some"), "empty").otherwise("populated").alias("load_state"))
