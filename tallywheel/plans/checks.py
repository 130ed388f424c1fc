"""Registered queries of what the ledger refuses, guards and keeps track of, each with its SQL."""

from __future__ import annotations

from dataclasses import replace as changed

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallywheel.operators.ledger import Commit, IdentityConflict, InvalidRecord, Ledger, compare_again, validate
from tallywheel.operators.pricing import RateDataset
from tallywheel.plans import queries as Q
from tallywheel.plans import views as V
from tallywheel.plans.bucketed import ledger_tables
from tallywheel.plans.export import json_lines, write_csv, write_reconciliation
from tallywheel.plans.journals import _E, _G, _GOOD, _eight, _events, _n, _object, _own_lines, _records, _text, _u, folder, put
from tallywheel.plans.registry import ORACLE_SQL, _with, register
from tallywheel.plans.views import _read
from tallywheel.schema import BUCKETS, COSTS, RECORD, struct
from tallywheel.sources.readers import EventLines, SessionTrees, WireJournals
from tallywheel.sources.rollouts import Rollouts
from tallywheel.streaming.incremental import scan

# -- records


def records_of(events: DataFrame) -> DataFrame:
    """RECORD rows of events(n, u, ms, event_type), with a price that the source reports on every third."""
    given = {
        "source_object_id": F.format_string("src-%d", _u() % 8), "event_id": _text("e-", _n()), "session_id": _text("s-", _u()), "client": F.col("event_type"), "provider": F.lit("p"), "model": _text("m-", _u() % 5), "occurred_at_unix_ms": F.col("ms"),
        "input_tokens": _n() % 211, "output_tokens": _u(), "cache_read_tokens": F.lit(0), "cache_write_tokens": F.lit(0), "reasoning_tokens": F.lit(0), "confidence": F.lit("exact"), "schema_variant": F.lit("v"), "timestamp_origin": F.lit("source"), "normalization_notes": F.array(),
        "costs": F.when(_n() % 3 == 0, F.array(cost("provider_reported", _n()))).otherwise(F.array().cast(COSTS)),
    }
    return events.select(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in struct(RECORD).fields))


def cost(kind: str, nanos: Column | None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), (F.lit(None) if nanos is None else nanos).cast("bigint").alias("usd_nanos"), F.lit("exact").alias("confidence"))


_PROBLEM = """CASE n % 11 WHEN 1 THEN 'a required field is missing' WHEN 2 THEN 'a token count is missing or negative' WHEN 3 THEN 'unknown confidence' WHEN 4 THEN 'a cost has no amount'
  WHEN 5 THEN 'a credit or unpriced mark has an amount' WHEN 6 THEN 'a cost is negative' END"""


def _odd_records(spark, d) -> DataFrame:
    """Records of which six in eleven break a rule each."""
    n = F.substring("event_id", 3, 20).cast("long") % 11
    odd = {4: cost("api_equivalent_estimate", None), 5: cost("subscription_credit", F.lit(1)), 6: cost("provider_reported", F.lit(-1))}
    costs = F.col("costs")
    for k, c in odd.items():
        costs = F.when(n == k, F.array(c)).otherwise(costs)
    return records_of(_events(spark, d)).withColumns({"model": F.when(n != 1, F.col("model")), "output_tokens": F.when(n == 2, -1).otherwise(F.col("output_tokens")), "confidence": F.when(n == 3, "guessed").otherwise(F.col("confidence")), "costs": costs})


@register("invalid_records", f"WITH {_E} SELECT 'src-' || (u % 8) AS source_object_id, 'e-' || n AS event_id, {_PROBLEM} AS problem FROM e WHERE n % 11 BETWEEN 1 AND 6")
def invalid_records(spark, d):
    """What the ledger's rules forbid, and why: fields, counts, confidence, costs with and without an amount."""
    return validate(_odd_records(spark, d)).select("source_object_id", "event_id", "problem")


@register("cost_conflicts", f"""
WITH {_E} SELECT 'src-' || (u % 8) AS source_object_id, 'e-' || n AS event_id, n % 4 = 1 OR (n % 4 = 2 AND n % 3 = 0) AS conflict FROM e WHERE n % 2 = 1 OR n % 4 = 2""")  # fmt: skip
def cost_conflicts(spark, d):
    """Events that are shown again: with the same costs in another order, with one more, with none. A set that differs is a conflict."""
    once = records_of(_events(spark, d)).withColumn("n", F.substring("event_id", 3, 20).cast("long"))
    two = F.array(cost("provider_reported", F.col("n")), cost("subscription_credit", None))
    stored = once.withColumn("costs", F.when(F.col("n") % 4 == 3, two).otherwise(F.col("costs")))
    again = once.filter("n % 2 = 1 OR n % 4 = 2").withColumn("costs", F.when(F.col("n") % 4 == 3, F.reverse(two)).when(F.col("n") % 4 == 1, F.concat("costs", F.array(cost("subscription_credit", None)))).otherwise(F.array().cast(COSTS)))
    same = lambda df: df.withColumn("__costs", F.array_sort("costs"))
    return compare_again(same(stored), same(again), ["client", "model", "__costs"]).select("source_object_id", "event_id", "conflict")


@register("refused_commits", f"""
WITH {_G}, c AS (SELECT k, 'src-' || k AS source_object_id, count(*) AS seen FROM g GROUP BY k)
SELECT source_object_id, 'append' AS mode, CASE WHEN k < 5 THEN 'completed' ELSE 'failed' END AS status, CASE WHEN k < 5 THEN seen ELSE 0 END AS seen, CASE WHEN k < 5 THEN seen ELSE 0 END AS inserted, CASE WHEN k < 5 THEN 0 WHEN k = 5 THEN 1 ELSE 2 END AS refused FROM c""")  # fmt: skip
def refused_commits(spark, d):
    """A commit of eight sources: one holds a record that is not allowed, two show an event twice with other facts; the others go in."""
    root, rows = folder(spark), records_of(_events(spark, d))
    first = F.col("event_id") == F.min("event_id").over(W.partitionBy("source_object_id"))
    rows = rows.withColumn("first", first)
    twice = rows.filter("first AND source_object_id IN ('src-6', 'src-7')").withColumn("model", F.lit("another"))
    bad = F.when(F.col("first") & (F.col("source_object_id") == "src-5"), -1)
    rows = rows.unionByName(twice).withColumn("output_tokens", F.coalesce(bad, F.col("output_tokens")).cast("long")).drop("first")
    ledger, names = Ledger(spark, root / "ledger"), [f"src-{k}" for k in range(8)]
    ledger.register_sources({"id": "i", "adapter_id": "own", "root_path": "/r"}, [{"id": s, "native_path": s, "kind": "append_only_jsonl", "parser_version": 1} for s in names])
    done = ledger.apply_all([Commit(s) for s in names], rows, 10)
    why = {s: 1 if isinstance(r, InvalidRecord) else 2 if isinstance(r, IdentityConflict) else 0 for s, r in done.items()}
    log = ledger.table("ingest_runs").select("source_object_id", "mode", "status", "seen", "inserted")
    return log.join(spark.createDataFrame(list(why.items()), "source_object_id string, refused int"), "source_object_id")


# -- registrations, snapshots and guards


@register("ledger_installations", """
SELECT 'nation-' || n_nationkey AS id, 'adapter-' || n_regionkey AS adapter_id, n_nationkey <> 3 AS enabled, CASE n_nationkey WHEN 3 THEN 'denied' WHEN 4 THEN 'granted' ELSE 'unknown' END AS permission_state, n_nationkey % 2 = 0 AS has_source FROM nation""")  # fmt: skip
def ledger_installations(spark, d):
    """Installations and sources as they are registered: again without losing their state, one of them disabled, one granted."""
    ledger = Ledger(spark, folder(spark) / "ledger")
    rows = _read(spark, d, "nation").select("n_nationkey", "n_regionkey").collect()  # an installation each
    made = [{"id": f"nation-{r[0]}", "adapter_id": f"adapter-{r[1]}", "root_path": f"/{r[0]}"} for r in rows]
    ledger.register_installations(made)
    ledger.set_installation_state("nation-3", False, "denied")
    ledger.set_installation_state("nation-4", True, "granted")
    for i in made[::2][:3]:
        ledger.register_source(f"source-{i['id']}", i, "f")  # keeps the state of its installation
    ledger.register_sources(made[0], [{"id": f"source-{i['id']}", "native_path": "f", "kind": "append_only_jsonl", "parser_version": 1} for i in made[::2]])
    has = spark.createDataFrame([(i["id"], ledger.source_exists(f"source-{i['id']}")) for i in made], "id string, has_source boolean")
    return ledger.table("source_installations").select("id", "adapter_id", "enabled", "permission_state").join(has, "id")


@register("ledger_snapshots", f"""
WITH {_G}, m AS (SELECT DISTINCT u % 5 AS k FROM g) SELECT k + 1 AS id, 'model-' || k AS dataset_version, 100 + k AS fetched_at_unix_ms FROM m""")  # fmt: skip
def ledger_snapshots(spark, d):
    """Pricing snapshots: each content once, with the time at which it was first seen, whatever order its rates come in."""
    ledger = Ledger(spark, folder(spark) / "ledger")
    models = sorted(r[0] for r in _events(spark, d).select(_u() % 5).distinct().collect())  # five models
    for again in (0, 1000):
        for k in models:
            rates = {f"m-{k}": (k, 1, 1, 1, 1), "other": (9, 9, 9, 9, 9)}
            ledger.record_snapshot(RateDataset("own", f"model-{k}", rates if again else dict(reversed(rates.items())), {}), 100 + k + again)
    return ledger.table("pricing_snapshots").select("id", "dataset_version", "fetched_at_unix_ms")


class _Mixed(EventLines):
    """Finds every other journal to be of a kind that the reader doesn't read."""

    def discover(self, spark=None):
        return [changed(c, kind="mutable_json") if int(c.path[-7]) % 2 else c for c in super().discover(spark)]


@register("scan_kind_guard", f"""
WITH {_G}, c AS (SELECT k, count(*) FILTER ({_GOOD}) AS n FROM g GROUP BY k)
SELECT 'reference-jsonl:events-' || k || '.jsonl' AS source_object_id, CASE WHEN k % 2 = 0 THEN 'completed' ELSE 'failed' END AS status, CASE WHEN k % 2 = 0 THEN n ELSE 0 END AS inserted, CASE WHEN k % 2 = 1 THEN 'schema' END AS problem FROM c""")  # fmt: skip
def scan_kind_guard(spark, d):
    """A scan whose files are partly of a kind that the reader refuses: those fail alone."""
    root = folder(spark)
    put(_own_lines(_events(spark, d), _eight()), root / "in")
    ledger = Ledger(spark, root / "ledger")
    scan(ledger, [("own", _Mixed(root / "in"))], 1_000)
    kind = F.nullif(F.regexp_extract("error", r"^\[([a-z]+)\]", 1), F.lit(""))
    return ledger.table("ingest_runs").select("source_object_id", "status", "inserted", kind.alias("problem"))


# -- what readers have to make of odd files


@register("journal_file_times", f"WITH {_E} SELECT 'named-' || (n % 9) AS model, CASE WHEN n % 3 = 0 THEN ms ELSE 1600000000000 END AS occurred_at_unix_ms, (n % 211)::BIGINT AS input_tokens, CASE WHEN n % 3 = 0 THEN 'source' ELSE 'file_modified' END AS timestamp_origin FROM e WHERE n % 211 > 0")
def journal_file_times(spark, d):
    """Wire records without a time take their file's."""
    root = folder(spark)
    usage = _object(inputOther=_n() % 211, output=F.lit(0), inputCacheRead=F.lit(0), inputCacheCreation=F.lit(0))
    # The number makes each record one of its own.
    line = F.to_json(_object(type=F.lit("usage.record"), model=_text("named-", _n() % 9), usage=usage, usageScope=_text("n-", _n()), time=F.when(_n() % 3 == 0, F.col("ms"))))
    put(_events(spark, d).select(F.format_string("sessions/%d/wire.jsonl", _u()).alias("file"), _n().alias("at"), line.alias("line")), root, modified_s=1_600_000_000)
    return _records(spark, WireJournals(root)).select("model", "occurred_at_unix_ms", "input_tokens", "timestamp_origin")


@register("journal_headers", f"""
WITH {_E} SELECT 'first-' || u AS session_id, 'pi-session-jsonl-v' || (u % 4) AS schema_variant, greatest(n % 50 - 10, 0)::BIGINT AS input_tokens, 'exact' AS confidence
FROM e WHERE u % 6 < 4 AND n % 50 > 10""")  # fmt: skip
def journal_headers(spark, d):
    """Sessions of several versions: the first header counts, later ones don't; a newer version and a header without an id are
    left out; negative counts are taken as zero, and a record that has nothing left is passed over."""
    e, root = _events(spark, d), folder(spark)
    file = F.format_string("s-%d.jsonl", _u())
    head = lambda id, version: F.to_json(_object(type=F.lit("session"), version=version, id=id))
    version = F.when(_u() % 6 == 4, 9).otherwise(_u() % 4)
    users = e.select("u").distinct()
    first = users.select(file.alias("file"), F.lit(-2).cast("long").alias("at"), head(F.when(_u() % 6 != 5, _text("first-", _u())), version).alias("line"))
    later = users.select(file.alias("file"), F.lit(-1).cast("long").alias("at"), head(F.lit("later"), F.lit(1)).alias("line"))
    usage = _object(input=_n() % 50 - 10, output=F.lit(0), cacheRead=F.lit(0), cacheWrite=F.lit(0))
    entry = F.to_json(_object(type=F.lit("message"), id=_text("n-", _n()), timestamp=F.col("said"), message=_object(role=F.lit("assistant"), model=F.lit("m"), usage=usage)))
    put(first.unionByName(later).unionByName(e.select(file.alias("file"), _n().alias("at"), entry.alias("line"))), root)
    return _records(spark, SessionTrees(root)).select("session_id", "schema_variant", "input_tokens", "confidence")


@register("journal_rollout_heads", f"""
WITH {_E} SELECT 'r-' || u AS session_id, 'openai' AS provider, CASE u % 6 WHEN 0 THEN 'codex-cli' WHEN 1 THEN 'codex-vscode' ELSE 'codex-cli' END AS client, (n % 17 + 1)::BIGINT AS input_tokens FROM e WHERE u % 6 < 3""")  # fmt: skip
def journal_rollout_heads(spark, d):
    """Rollouts whose source is a text, an object, a list, a number or absent, and whose later headers say otherwise: the first
    one counts, and what no person started is left out."""
    e, root = _events(spark, d), folder(spark)
    file = F.format_string("sessions/2024/rollout-%d.jsonl", _u())
    source = F.element_at(F.array(F.lit('"cli"'), F.lit('"vscode"'), F.lit(None).cast("string"), F.lit('{"sub":"agent"}'), F.lit("[1]"), F.lit("7")), (_u() % 6 + 1).cast("int"))
    told = F.when(source.isNotNull(), F.concat(F.lit(',"source":'), source)).otherwise("")
    first = F.concat(F.lit('{"timestamp":"2024-01-01T00:00:00Z","type":"session_meta","payload":{"id":"r-'), _u().cast("string"), F.lit('","model_provider":"openai"'), told, F.lit("}}"))
    users = e.select("u").distinct()
    heads = users.select(file.alias("file"), F.lit(-2).cast("long").alias("at"), first.alias("line"))
    later = users.select(file.alias("file"), F.lit(-1).cast("long").alias("at"), F.lit('{"timestamp":"2024-01-01T00:00:00Z","type":"session_meta","payload":{"id":"later","model_provider":"other","source":"mcp"}}').alias("line"))
    info = _object(last_token_usage=_object(input_tokens=_n() % 17 + 1, output_tokens=F.lit(0), total_tokens=_n() % 17 + 1))
    counts = e.select(file.alias("file"), _n().alias("at"), F.to_json(_object(timestamp=F.col("said"), type=F.lit("event_msg"), payload=_object(type=F.lit("token_count"), info=info))).alias("line"))
    put(heads.unionByName(later).unionByName(counts), root)
    return _records(spark, Rollouts(root)).select("session_id", "provider", "client", "input_tokens")


# -- exports, read back


_EXPORTED = "event_id, session_id, occurred_at_unix_ms, client, nullif(provider, '') AS provider, model, total AS total_tokens, source_reported_total, confidence, unpriced, pricing_key, pricing_rule, input_tokens, output_tokens"


@register("export_json", _with(f"SELECT {_EXPORTED} FROM facts"))
def export_json(spark, d):
    """The exported JSON objects, read back from their text."""
    inner = "struct<input:bigint,output:bigint,cacheRead:bigint,cacheWrite:bigint,reasoning:bigint>"
    kind = f"eventId string, sessionId string, occurredAtUnixMs bigint, client string, provider string, model string, totalTokens bigint, sourceReportedTotal bigint, confidence string, unpriced boolean, pricingKey string, pricingRule string, tokens {inner}"
    j = json_lines(V.ledger(spark, d)).select(F.from_json("event", kind).alias("j"))
    snake = {"eventId": "event_id", "sessionId": "session_id", "occurredAtUnixMs": "occurred_at_unix_ms", "totalTokens": "total_tokens", "sourceReportedTotal": "source_reported_total", "pricingKey": "pricing_key", "pricingRule": "pricing_rule"}
    same = ("client", "provider", "model", "confidence", "unpriced")
    return j.select(*(F.col(f"j.{a}").alias(b) for a, b in snake.items()), *(F.col(f"j.{c}") for c in same), F.col("j.tokens.input").alias("input_tokens"), F.col("j.tokens.output").alias("output_tokens"))


@register("export_csv", _with(f"SELECT {_EXPORTED} FROM facts"))
def export_csv(spark, d):
    """The exported CSV file, read back."""
    path = folder(spark) / "events.csv"
    write_csv(V.ledger(spark, d), path)
    kinds = {"occurred_at_unix_ms": "bigint", "total_tokens": "bigint", "source_reported_total": "bigint", "unpriced": "boolean", **dict.fromkeys(BUCKETS, "bigint")}
    rows = spark.read.csv(path.as_uri(), header=True)
    wanted = ("event_id", "session_id", "occurred_at_unix_ms", "client", "provider", "model", "total_tokens", "source_reported_total", "confidence", "unpriced", "pricing_key", "pricing_rule", "input_tokens", "output_tokens")
    return rows.select(*(F.col(c).cast(kinds.get(c, "string")).alias(c) for c in wanted))


@register("reconciliation_report", ORACLE_SQL["source_reconciliation"])
def reconciliation_report(spark, d):
    """The sources of the reconciliation report, read back from the document."""
    path, rows = folder(spark) / "report.json", Q.source_reconciliation(V.usage_events(spark, d))
    write_reconciliation(rows, rows.limit(0), path, 1)
    kind = f"struct<sources:array<{rows.schema.simpleString()}>>"
    return spark.read.text(path.as_uri(), wholetext=True).select(F.explode(F.from_json("value", kind)["sources"]).alias("s")).select("s.*")


# -- the same questions without a shuffle of events


@register("bucketed_sessions", ORACLE_SQL["session_summaries"])
def bucketed_sessions(spark, d):
    """Session summaries over events and costs that were written in buckets by event."""
    events, costs = ledger_tables(V.usage_events(spark, d), V.event_costs(spark, d))
    return Q.session_summaries(Q.facts(events, costs))
