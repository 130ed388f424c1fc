"""Rate tables, lookup and exact cost estimates."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywheel.functions.identity import fnv1a64
from tallywheel.functions.money import U64_MAX
from tallywheel.schema import BUCKETS, ESTIMATE, UNPRICED

RATES = ("input_rate", "output_rate", "cache_read_rate", "cache_write_rate", "reasoning_rate")

#: Nano-USD a token (input, output, cache read, cache write, reasoning) by model.
REVIEWED_RATES = {
    "gpt-5.3-codex": (1750, 14000, 175, 1750, 14000),
    "gpt-5.6-terra": (2000, 12000, 200, 2500, 12000),
    "gpt-5.6-sol": (5000, 30000, 500, 6250, 30000),
    "gpt-5.6-luna": (200, 1200, 20, 250, 1200),
    "gpt-5.6-cyber": (12500, 75000, 1250, 15625, 75000),
    "kimi-k2.7-code": (950, 4000, 190, 950, 4000),
    "kimi-k2.7-code-highspeed": (1900, 8000, 380, 1900, 8000),
    "kimi-k3": (3000, 15000, 300, 3000, 15000),
    "claude-opus-5-5": (45000, 225000, 4500, 56250, 225000),
    "claude-sonnet-4-7": (3000, 15000, 300, 3750, 15000),
    "claude-haiku-4-6": (1000, 5000, 100, 1250, 5000),
    "claude-opus-4-5": (15000, 75000, 1500, 18750, 75000),
    "claude-opus-4-1": (15000, 75000, 1500, 18750, 75000),
    "claude-sonnet-4-5": (3000, 15000, 300, 3750, 15000),
    "claude-haiku-4-5": (1000, 5000, 100, 1250, 5000),
    "deepseek-v4-flash": (440, 1320, 14, 440, 1320),
    "deepseek-v4-pro": (1320, 3960, 44, 1320, 3960),
}
#: Other names of the same models.
REVIEWED_ALIASES = {
    "kimi-for-coding": "kimi-k2.7-code",
    "kimi-for-coding-highspeed": "kimi-k2.7-code-highspeed",
    "deepseek-chat": "deepseek-v4-flash",
    "deepseek-reasoner": "deepseek-v4-flash",
}


@dataclass(frozen=True)
class RateDataset:
    """A versioned rate table. Keys are model or provider/model names; aliases point to keys."""

    source: str = "reviewed"
    version: str = "2026-08-19.1"
    rates: dict[str, tuple[int, ...]] = field(default_factory=lambda: dict(REVIEWED_RATES))
    aliases: dict[str, str] = field(default_factory=lambda: dict(REVIEWED_ALIASES))

    @property
    def provenance(self) -> str:
        return f"{self.source}@{self.version}"

    def content_hash(self) -> str:
        """The same for the same content, in whatever order it was given."""
        return f"{fnv1a64(json.dumps([sorted(self.rates.items()), sorted(self.aliases.items())]).encode()):016x}"

    def table(self, spark: SparkSession) -> DataFrame:
        """(name, key, rule, rates): every name that finds a rate. It has a row for each key and alias of the dataset."""
        rows = [(k, k, "exact", *r) for k, r in self.rates.items()]
        rows += [(a, k, f"alias:{a}", *self.rates[k]) for a, k in self.aliases.items() if k in self.rates and a not in self.rates]
        return spark.createDataFrame(rows, "name string, pricing_key string, pricing_rule string, " + ", ".join(f"{x} bigint" for x in RATES))


def cost(tokens: list[Column], rates: list[Column]) -> Column:
    """The exact sum of tokens times rates in nano-USD; null beyond an unsigned 64-bit count."""
    parts = [t.cast("decimal(20,0)") * r.cast("decimal(17,0)") for t, r in zip(tokens, rates, strict=True)]
    total = sum(parts[1:], parts[0])
    return F.when(total <= F.lit(str(U64_MAX)).cast("decimal(20,0)"), total.cast("decimal(20,0)"))


def estimate(events: DataFrame, dataset: RateDataset) -> DataFrame:
    """events with usd_nanos, pricing_key, pricing_rule and kind of the estimate.

    The first of provider/model, the bare model, and an alias of either wins; names are never guessed. The rate table is
    the dataset's own few rows, so it is broadcast; each event is looked up without a shuffle.
    """
    rates = dataset.table(events.sparkSession)
    direct = F.broadcast(rates.filter("pricing_rule = 'exact'"))
    alias = F.broadcast(rates.filter("pricing_rule <> 'exact'"))
    full = F.when((F.coalesce("provider", F.lit("")) != "") & (F.col("model") != ""), F.concat_ws("/", "provider", "model"))
    bare = F.when(F.col("model") != "", F.col("model"))
    fields = ("pricing_key", "pricing_rule", *RATES)
    out = events.withColumns({"__full": full, "__bare": bare})
    for step, (names, on) in enumerate(((direct, "__full"), (direct, "__bare"), (alias, "__full"), (alias, "__bare"))):
        side = names.select(F.col("name").alias(on), F.struct(*fields).alias(f"__r{step}"))
        out = out.join(side, on, "left")
    found = F.coalesce(*(f"__r{i}" for i in range(4)))
    out = out.withColumn("__r", found)
    nanos = cost([F.col(b) for b in BUCKETS], [F.col("__r")[r] for r in RATES])
    over = nanos.isNull() | (nanos > F.lit(2**63 - 1).cast("decimal(20,0)"))
    has = F.col("__r").isNotNull()
    return out.withColumns({
        "usd_nanos": F.when(has & ~over, nanos.cast("long")),
        "pricing_key": F.when(has & ~over, F.col("__r.pricing_key")),
        "pricing_rule": F.when(~has, "unpriced:no-match").when(over, "unpriced:overflow").otherwise(F.col("__r.pricing_rule")),
        "kind": F.when(has & ~over, ESTIMATE).otherwise(UNPRICED),
    }).drop("__full", "__bare", "__r", *(f"__r{i}" for i in range(4)))


def estimate_facts(events: DataFrame, dataset: RateDataset, snapshot_id: int | None = None) -> DataFrame:
    """Cost rows (one for each event) of a dataset."""
    return estimate(events, dataset).select(
        "source_object_id", "event_id", "kind", "usd_nanos", F.lit(snapshot_id).cast("long").alias("pricing_snapshot_id"), "pricing_key", "pricing_rule", F.lit("estimated").alias("confidence")
    )


def replace_estimates(costs: DataFrame, facts: DataFrame) -> DataFrame:
    """costs with all estimates and unpriced marks replaced; facts of the providers stay."""
    return costs.filter(~F.col("kind").isin(ESTIMATE, UNPRICED)).unionByName(facts)


def reprice_counters(facts: DataFrame) -> DataFrame:
    return facts.agg(
        F.coalesce(F.sum(F.when(F.col("kind") == ESTIMATE, 1)), F.lit(0)).alias("priced"),
        F.coalesce(F.sum(F.when(F.col("kind") == UNPRICED, 1)), F.lit(0)).alias("unpriced"),
    )


def rate_card(spark: SparkSession, dataset: RateDataset) -> DataFrame:
    """Per key the rates in nano-USD for a million tokens, and its aliases in order."""
    rows = dataset.table(spark)
    keys = rows.filter("pricing_rule = 'exact'").select("pricing_key", *((F.col(r) * 1_000_000).alias(r.replace("_rate", "_per_million")) for r in RATES))
    other = rows.filter("pricing_rule <> 'exact'").groupBy("pricing_key").agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("aliases"))
    return keys.join(other, "pricing_key", "left").withColumn("aliases", F.coalesce("aliases", F.lit("")))
