"""Thread documents: a usage ledger and the messages of a thread, which report the same usage twice."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tallywheel.functions import identity, timeutil
from tallywheel.functions.money import U64_MAX
from tallywheel.operators.pairing import greedy_pairs
from tallywheel.sources.lines import Batch, Candidate, collected, files_under, whole_files
from tallywheel.sources.readers import Reader, _expanded, _home, _home_of, _json, _note, _notes, _records, _sum
from tallywheel.tables import settled

_TOKENS = "input:bigint,output:bigint,cacheReadInputTokens:bigint,cacheCreationInputTokens:bigint"
_USAGE = "inputTokens:bigint,outputTokens:bigint,cacheReadInputTokens:bigint,cacheCreationInputTokens:bigint"
_T = (
    f"id string, created bigint, usageLedger struct<events:array<struct<timestamp:string,model:string,credits:double,tokens:struct<{_TOKENS}>,toMessageId:bigint>>>, "
    f"messages array<struct<role:string,messageId:bigint,usage:struct<model:string,{_USAGE},credits:double>>>"
)
COUNTS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")


class Threads(Reader):
    """T-*.json documents; reading one replaces what it said before."""

    id = "amp-threads"
    kinds = ("mutable_json",)
    resumable = False

    def __init__(self, root):
        self.root = _home_of(root)

    @staticmethod
    def default_roots(env=None):
        env = os.environ if env is None else env
        data = _expanded(env["XDG_DATA_HOME"], env) if env.get("XDG_DATA_HOME") else _home(env) / ".local" / "share"
        return [data / "amp" / "threads"]

    def discover(self, spark=None):
        return [Candidate(str(p).rsplit("/", 1)[-1], str(p), "mutable_json") for p in files_under(self.root, "T-*.json", recursive=False)]

    def read(self, spark, candidates, offsets=None, states=None):
        """Records come by source, time and event id. Each message, in order, takes the first free ledger row with its message
        id, else the first with its model and counts; a message that finds none is usage of its own."""
        kept = []
        docs = whole_files(spark, candidates).withColumn("t", _json("text", _T))
        ok = F.coalesce(F.col("t").isNotNull() & F.col("t.__bad").isNull(), F.lit(False))
        broken = docs.filter(~ok).select("source_key", F.lit("[schema] the document is no thread").alias("warning"))
        stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.json$", "")
        docs = docs.filter(ok).select("source_key", "modified_unix_ms", F.coalesce(F.nullif("t.id", F.lit("")), stem).alias("thread"), F.when(F.col("t.created") > 0, F.col("t.created")).alias("created"), F.col("t.usageLedger.events").alias("events"), F.col("t.messages").alias("messages"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        base = ["source_key", "modified_unix_ms", "thread", "created", "pos"]
        e = docs.select(*base[:4], F.posexplode("events").alias("pos", "e"))
        e = e.select(*base, F.lit("ledger").alias("kind"), F.col("e.timestamp").alias("said"), F.col("e.model").alias("m"), F.col("e.credits").isNotNull().alias("credit"), zero("e.tokens.input").alias("a"), zero("e.tokens.output").alias("b"), zero("e.tokens.cacheReadInputTokens").alias("c"), zero("e.tokens.cacheCreationInputTokens").alias("d"), F.col("e.toMessageId").alias("mid"))
        g = docs.select(*base[:4], F.posexplode("messages").alias("pos", "g")).filter("g.role = 'assistant' AND g.usage IS NOT NULL")
        g = g.select(*base, F.lit("message").alias("kind"), F.lit(None).cast("string").alias("said"), F.col("g.usage.model").alias("m"), F.col("g.usage.credits").isNotNull().alias("credit"), zero("g.usage.inputTokens").alias("a"), zero("g.usage.outputTokens").alias("b"), zero("g.usage.cacheReadInputTokens").alias("c"), zero("g.usage.cacheCreationInputTokens").alias("d"), F.col("g.messageId").alias("mid"))
        rows = e.unionByName(g)
        name = F.concat(F.when(F.col("kind") == "ledger", "row ").otherwise("message "), F.col("pos").cast("string"), F.lit(": "))
        at = timeutil.rfc3339_millis(F.col("said"))
        rows = rows.withColumns({
            "message_id": F.when(F.col("mid") > 0, F.col("mid")), "derived": F.least("a", "b", "c", "d") < 0, "model": F.coalesce(F.nullif("m", F.lit("")), F.lit("unknown")), "at": F.nullif(at, F.lit(0)),
            **{n: F.greatest(F.col(x), F.lit(0)) for n, x in zip(COUNTS, "abcd", strict=True)},
        })
        rows = rows.withColumn("total", _sum(*(F.col(c) for c in COUNTS)))
        over = F.col("total") > F.lit(str(U64_MAX)).cast("decimal(20,0)")
        usable = (F.col("total") > 0) & ~over
        rows = rows.withColumn("says", F.array(
            F.when(F.col("derived"), F.concat(name, F.lit("negative counts were taken as zero"))),
            F.when(F.col("total") == 0, F.concat(name, F.lit("it counts nothing and was passed over"))),
            F.when(over, F.concat(name, F.lit("its counts go beyond 64 bits; it was passed over"))),
            F.when(usable & F.col("said").isNotNull() & F.col("at").isNull(), F.concat(name, F.lit("its time can't be read; another was taken"))),
            F.when(usable & (F.coalesce(F.col("m"), F.lit("")) == ""), F.concat(name, F.lit("it names no model"))),
        ))
        rows = settled(rows, "threads", kept)
        credits = rows.groupBy("source_key").agg(F.sum(F.col("credit").cast("long")).alias("n")).filter("n > 0")
        warnings = broken.unionByName(collected(rows, "says")).unionByName(credits.select("source_key", F.format_string("%d amounts of credit were seen; they are no prices and were not kept", "n").alias("warning")))
        rows = rows.filter(usable).drop("says")
        side = lambda kind: rows.filter(F.col("kind") == kind).select("source_key", "pos", F.col("message_id").alias("first"), F.struct("model", *COUNTS).alias("second"))
        pairs = settled(greedy_pairs(side("message"), side("ledger"), "source_key"), "thread-pairs", kept)
        said = rows.filter("kind = 'message'").select("source_key", F.col("pos").alias("asker"), F.col("model").alias("other"), F.struct(*COUNTS).alias("counted"), F.coalesce("message_id", F.lit(0)).alias("id"))
        taken = pairs.join(said, ["source_key", "asker"]).select("source_key", F.lit("ledger").alias("kind"), F.col("taken").cast("int").alias("pos"), "other", "counted", "id")
        gone = pairs.select("source_key", F.lit("message").alias("kind"), F.col("asker").cast("int").alias("pos"))
        rows = rows.join(gone, ["source_key", "kind", "pos"], "left_anti").join(taken, ["source_key", "kind", "pos"], "left")
        unlike = F.col("counted").isNotNull() & (F.col("counted") != F.struct(*COUNTS))
        warnings = warnings.unionByName(rows.filter(unlike).select("source_key", F.format_string("message %d counts otherwise than its row of the ledger; the row was taken", "id").alias("warning")))
        rows = rows.withColumn("model", F.when(F.col("model") == "unknown", F.coalesce("other", "model")).otherwise(F.col("model")))
        origin = F.when(F.col("at").isNotNull(), "source").when(F.col("created").isNotNull(), "derived").otherwise("file_modified")
        prefix = F.when(F.col("kind") == "ledger", "toMessageId:").otherwise("messageId:")
        records = _records(
            rows, event_id=F.concat(F.lit("amp-local-v1:"), identity.sha256_of("amp-local-v1", F.col("thread"), F.col("kind"), F.col("pos"), F.coalesce("message_id", F.lit(0)))), session_id=F.col("thread"), client=F.lit("amp"), model=F.col("model"),
            occurred_at_unix_ms=F.coalesce("at", "created", "modified_unix_ms"), **{c: F.col(c) for c in COUNTS}, reasoning_tokens=F.lit(0), confidence=F.when(F.col("derived"), "derived").otherwise("exact"), native_id=F.concat(prefix, F.col("message_id").cast("string")),
            record_offset=F.lit(None), schema_variant=F.lit("amp-local-thread-v1"), timestamp_origin=origin, normalization_notes=_notes(_note(origin == "derived", "no time of its own; the thread's was used"), _note(origin == "file_modified", "no time at all; the file's was used")),
        )
        return Batch(records.orderBy("source_object_id", "occurred_at_unix_ms", "event_id"), warnings, kept=kept)
