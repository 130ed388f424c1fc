"""Rollout journals: cumulative counters, carried models, forks that replay their parent, and pages of a longer thread."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallywheel.functions import identity, timeutil
from tallywheel.operators import lineage, sequences
from tallywheel.schema import BUCKETS
from tallywheel.sources.lines import Batch, Candidate, collected, files_under, read_lines
from tallywheel.sources.readers import Reader, _at, _begins, _expanded, _home, _home_of, _json, _note, _notes, _records, _seeded, _since, _states, _under
from tallywheel.tables import settled, tasks_for

COUNTERS = ("input_tokens", "cached_input_tokens", "cache_write_input_tokens", "output_tokens", "reasoning_output_tokens")
EVERY = (*COUNTERS, "total_tokens")
_U = f"struct<{','.join(f'{c}:bigint' for c in EVERY)}>"
_C = (
    "timestamp string, ordinal bigint, type string, payload struct<type:string,id:string,session_id:string,forked_from_id:string,history_mode:string,"
    f"history_base:struct<thread_id:string,end_ordinal_exclusive:bigint,end_byte_offset:bigint>,source:string,originator:string,model_provider:string,model:string,info:struct<total_token_usage:{_U},last_token_usage:{_U}>>"
)


_H = "struct<id:string,source:string,originator:string,provider:string,ms:bigint,fork:string,mode:string,base:struct<thread_id:string,end_ordinal_exclusive:bigint,end_byte_offset:bigint>,at:bigint>"
#: What the next batch of a file has to know: its head and model, the counters, how many reports there were, and how far the
#: replay of a parent has come.
_STATE = f"struct<h:{_H},model:string,total:{_U},pos:bigint,n_expected:bigint,same:int,first_apart:bigint,lost:boolean>"
_EXPECTED = f"struct<timestamp:string,total:{_U},last:{_U}>"
#: A file's lineage is told by its first record, which is sought in so many bytes.
HEAD_BYTES = 1 << 16


class Rollouts(Reader):
    """rollout-*.jsonl files, plain or zstd, active or archived; of files with one name the most active plain one counts."""

    id = "codex-rollout"
    parser_version = 2

    def __init__(self, home):
        self.home = _home_of(home)

    @staticmethod
    def default_roots(env=None):
        env = os.environ if env is None else env
        return [_expanded(env["CODEX_HOME"], env) if env.get("CODEX_HOME") else _home(env) / ".codex"]

    def discover(self, spark=None):
        best: dict[str, tuple[int, Candidate]] = {}
        for folder, rank in (("archived_sessions", 0), ("sessions", 2)):
            for p in map(str, [*files_under(_under(self.home, folder), "*.jsonl"), *files_under(_under(self.home, folder), "*.jsonl.zst")]):
                name = p.rsplit("/", 1)[-1]
                key, level = name.removesuffix(".zst"), rank + name.endswith(".jsonl")
                if key not in best or best[key][0] < level:
                    best[key] = (level, Candidate(key, p))
        return [c for _, (_, c) in sorted(best.items())]

    @staticmethod
    def _parsed(lines: DataFrame) -> DataFrame:
        """What is needed of each line: the line itself stays behind, as windows by file sort these rows."""
        rows = lines.withColumn("size", F.octet_length("line") + 1).withColumn("line", F.trim("line")).withColumn("c", _json("line", _C))
        usage = lambda name: F.when(F.col(f"c.payload.info.{name}").isNotNull(), F.struct(*(F.coalesce(F.col(f"c.payload.info.{name}.{x}"), F.lit(0)).alias(x) for x in EVERY)))
        ok = F.coalesce(F.col("c").isNotNull() & F.col("c.__bad").isNull() & F.col("c.type").isNotNull(), F.lit(False))
        rows = rows.withColumns({"ok": ok, "total": usage("total_token_usage"), "last": usage("last_token_usage"), "ms": timeutil.rfc3339_millis(F.col("c.timestamp"))})
        told = F.get_json_object("line", "$.payload.source")
        source = F.when(told.isNotNull(), F.when(told.rlike(r"^[\[{]|^(true|false|-?[0-9.]+)$"), "non_cli").otherwise(F.col("c.payload.source")))
        head = F.struct(F.coalesce("c.payload.id", "c.payload.session_id").alias("id"), source.alias("source"), F.col("c.payload.originator").alias("originator"), F.nullif("c.payload.model_provider", F.lit("")).alias("provider"), F.col("ms").alias("ms"), F.nullif("c.payload.forked_from_id", F.lit("")).alias("fork"), F.col("c.payload.history_mode").alias("mode"), F.col("c.payload.history_base").alias("base"), F.col("record_offset").alias("at"))
        report = F.col("ok") & (F.col("c.type") == "event_msg") & (F.col("c.payload.type") == "token_count")
        count = F.coalesce(report & F.col("c.payload.info").isNotNull(), F.lit(False))
        legacy = F.concat(F.lit("legacy:"), F.sha2(F.concat(F.col("source_key").cast("binary"), identity.little_endian_u64(F.col("record_offset")), F.col("line").cast("binary")), 256))
        return rows.select(
            "source_key", "modified_unix_ms", "record_offset", "size", "ok", "ms", "total", "last", F.col("c.timestamp").alias("timestamp"), F.col("c.ordinal").alias("ordinal"), F.when(count & F.col("c.ordinal").isNull(), legacy).alias("legacy"),
            F.when(F.col("ok") & (F.col("c.type") == "session_meta"), head.cast(_H)).alias("head"), F.when(F.col("ok") & (F.col("c.type") == "turn_context"), F.nullif("c.payload.model", F.lit(""))).alias("named"), report.alias("report"), count.alias("count"),
        )

    @staticmethod
    def _heads(rows: DataFrame) -> DataFrame:
        """What the first record of each file says of it; files that begin with another record have no lineage."""
        first = rows.filter("ok").groupBy("source_key").agg(F.min("record_offset").alias("record_offset"))
        return rows.filter("head IS NOT NULL").join(first, ["source_key", "record_offset"]).select("source_key", "head.*")

    def read(self, spark, candidates, offsets=None, states=None):
        """State: see _STATE. A file that goes on where it ended reads what was added; of other files its ancestors are read,
        and those only while a lineage is open (a file's first batch, or a replay that its last batch didn't end)."""
        kept = []
        begins = _begins(offsets, states)
        lines, warnings, ends = read_lines(spark, candidates, begins, kept)
        tasks = tasks_for(kept[-1])
        rows = _seeded(self._parsed(lines).repartition(tasks, "source_key"), states, _STATE)
        in_order = W.partitionBy("source_key").orderBy("record_offset")
        so_far, latest = in_order.rowsBetween(W.unboundedPreceding, 0), F.lead("record_offset").over(in_order).isNull()
        rows = rows.withColumns({"begun": F.min(F.when(F.col("ok"), F.col("record_offset"))).over(so_far), "latest": latest})
        rows = rows.withColumns({"h": F.coalesce(F.col("__s.h"), F.first("head", ignorenulls=True).over(so_far)), "model": F.coalesce(F.last("named", ignorenulls=True).over(so_far), F.col("__s.model"))})
        rows = settled(rows, "rollouts", kept)
        service = ~identity.is_interactive(F.col("h.source"))
        first_head = F.col("head").isNotNull() & (F.col("record_offset") == F.col("h.at"))
        says = F.array(
            _at(~F.col("ok"), "this line is no rollout record and was passed over"),
            F.when(first_head & service, F.lit("a rollout of a service, not of a person: its usage was left out")),
            _at(F.col("report") & ~F.col("count") & ~F.coalesce(service, F.lit(False)), "a report of counts without any was passed over"),
        )
        warnings = warnings.unionByName(collected(_since(rows, offsets).withColumn("says", says), "says"))
        seeds, replays, problems = self._lineage(spark, candidates, begins, rows, ends, kept)
        # Broken lineages are told once, with the batch in which they were followed.
        warnings = warnings.unionByName(problems.select("source_key", "warning"))
        counts = rows.filter(F.col("count") & ~F.coalesce(service, F.lit(False))).select("source_key", "modified_unix_ms", "record_offset", "ms", "total", "last", "timestamp", "ordinal", "legacy", "h", "model", "__s")
        counts = counts.repartition(tasks, "source_key")
        counts = counts.join(F.broadcast(seeds), "source_key", "left").join(F.broadcast(problems.groupBy("source_key").agg(F.lit(True).alias("now_lost"))), "source_key", "left")
        counts = counts.withColumns({"lost": F.coalesce("__s.lost", "now_lost", F.lit(False)), "seed": F.coalesce("__s.total", "seed")})
        counts = sequences.positions(counts, ["source_key"], "record_offset").withColumn("pos", F.col("pos") + F.coalesce("__s.pos", F.lit(0)))
        if replays is not None:
            counts = counts.join(replays, ["source_key", "pos"], "left").repartition(tasks, "source_key")
        else:
            counts = counts.withColumns({"expected": F.lit(None).cast(_EXPECTED), "expected_count": F.lit(None).cast("bigint")})
        by = W.partitionBy("source_key")
        same = F.min(F.struct("timestamp", "total", "last").eqNullSafe(F.col("expected")).cast("int")).over(so_far)
        counts = counts.withColumns({"n_expected": F.coalesce(F.max("expected_count").over(by), "__s.n_expected", F.lit(0)), "same": F.least(same, F.coalesce("__s.same", F.lit(1)))})
        within = F.col("pos") <= F.col("n_expected")
        counts = counts.withColumns({"replayed": within & (F.col("same") == 1), "diverges": within & (F.col("same") == 0)})
        counts = counts.withColumn("first_apart", F.coalesce("__s.first_apart", F.min(F.when(F.col("diverges"), F.col("pos"))).over(by)))
        counts = sequences.increments(counts, ["source_key"], "record_offset", COUNTERS, seed="seed", also=("total_tokens",)).withColumn("latest", latest)
        counts = settled(counts.drop("seed", "expected", "expected_count", "now_lost"), "rollout-counts", kept)
        # What the next batch has to know: the last line's head and model, the last report's counters.
        lately = rows.filter("latest").select("source_key", F.struct("h", "model", F.col("__s").alias("was")).alias("x"))
        last = counts.filter("latest").select("source_key", F.struct("after", "pos", "n_expected", F.when(F.col("pos") <= F.col("n_expected"), F.col("same")).otherwise(F.coalesce(F.when(F.col("first_apart").isNotNull(), 0), F.lit(1))).alias("same"), "first_apart", "lost").alias("y"))
        left = lately.join(last, "source_key", "left").join(problems.groupBy("source_key").agg(F.lit(True).alias("lost")), "source_key", "left").join(seeds, "source_key", "left")
        expects = F.lit(None).cast("bigint")
        if replays is not None:
            left, expects = left.join(replays.groupBy("source_key").agg(F.max("expected_count").alias("expects")), "source_key", "left"), F.col("expects")
        pick = lambda now, was, *rest: F.coalesce(F.col(f"y.{now}"), F.col(f"x.was.{was}"), *rest).alias(was)
        after = _states(ends, left, states, F.struct(F.col("x.h").alias("h"), F.col("x.model").alias("model"), pick("after", "total", F.col("seed")), pick("pos", "pos", F.lit(0).cast("long")), pick("n_expected", "n_expected", expects), pick("same", "same", F.lit(1)), pick("first_apart", "first_apart"), pick("lost", "lost", F.col("lost"))))
        apart = F.col("pos") == F.col("first_apart")
        d = {c: F.col("delta")[c] for c in EVERY}
        cached = d["cached_input_tokens"].cast("decimal(21,0)") + d["cache_write_input_tokens"]
        sums = d["input_tokens"].cast("decimal(21,0)") + d["output_tokens"]
        over_in, over_out = cached > d["input_tokens"], d["reasoning_output_tokens"] > d["output_tokens"]
        wrong = (d["total_tokens"] != 0) & (sums != d["total_tokens"])
        counts = _since(counts, offsets)
        out = F.col("emits") & ~F.col("replayed")
        counts = counts.withColumn("says", F.array(
            F.when(apart, F.format_string("the parent's usage is repeated for %d reports only; all that follows was kept", F.col("pos") - 1)),
            _at(~F.col("emits") & ~F.col("repeats"), "a report whose counts are all zero was passed over"),
            _at(F.col("reset"), "a counter fell; counting begins anew here"),
            _at(out & over_in, "more cached input than input; the rest of the input was taken as zero"),
            _at(out & over_out, "more reasoning than output; the rest of the output was taken as zero"),
            _at(out & wrong, "the total told is not input and output together"),
            _at(out & F.col("ms").isNull(), "no time that can be read; the file's time was taken"),
        ))
        warnings = warnings.unionByName(collected(counts, "says"))
        doubt = F.col("lost") | F.coalesce(F.col("pos") >= F.col("first_apart"), F.lit(False))
        rows = counts.filter(out).withColumn("doubt", doubt)
        client = F.when(F.col("h").isNull(), "codex-cli").otherwise(identity.client_of(F.coalesce("h.source", F.lit("cli")), F.col("h.originator")))
        place = F.coalesce(F.concat(F.lit("ordinal:"), F.col("ordinal").cast("string")), "legacy")
        raw = F.concat_ws(", ", *(F.concat(F.lit(f"{c}="), d[c].cast("string")) for c in EVERY))
        records = _records(
            rows, event_id=F.concat(F.lit("codex-v2:"), identity.sha256_of(F.col("source_key"), place)), session_id=F.coalesce(F.nullif("h.id", F.lit("")), "source_key"), client=client, provider=F.col("h.provider"), model=F.coalesce("model", F.lit("unknown")),
            occurred_at_unix_ms=F.coalesce("ms", "modified_unix_ms"), input_tokens=F.greatest(d["input_tokens"] - cached, F.lit(0)), output_tokens=F.greatest(d["output_tokens"] - d["reasoning_output_tokens"], F.lit(0)),
            cache_read_tokens=d["cached_input_tokens"], cache_write_tokens=d["cache_write_input_tokens"], reasoning_tokens=d["reasoning_output_tokens"], source_reported_total=F.nullif(d["total_tokens"], F.lit(0)),
            confidence=F.when(F.col("doubt") | over_in | over_out | wrong, "derived").otherwise("exact"), native_id=F.when(F.col("ordinal").isNotNull(), place), schema_variant=F.lit("codex-rollout-v2"),
            timestamp_origin=F.when(F.col("ms").isNull(), "file_modified").otherwise("source"),
            normalization_notes=_notes(_note(F.col("ms").isNull(), "no valid timestamp; the file's time was used"), F.concat(F.lit("raw usage: "), raw), _note(F.col("doubt"), "lineage could not be resolved exactly; usage was retained"), _note(client != "codex-cli", F.concat(F.lit("client "), client, F.lit(" from source "), F.coalesce("h.source", F.lit("unknown")), F.lit(" and originator "), F.coalesce("h.originator", F.lit("unknown"))))),
        )
        return Batch(records, warnings, ends, after, kept)

    def _lineage(self, spark: SparkSession, candidates, begins: dict[str, int], rows: DataFrame, ends: DataFrame, kept: list) -> tuple[DataFrame, DataFrame | None, DataFrame]:
        """Of the candidates whose lineage is open: (source_key, seed), the counters at which a page begins; (source_key, pos,
        expected, expected_count), what a fork repeats, None if no lineage is open; (source_key, warning), what can't be followed."""
        nothing = spark.createDataFrame([], f"source_key string, seed {_U}"), None, spark.createDataFrame([], "source_key string, warning string")
        whole = [c.source_key for c in candidates if not begins.get(c.source_key)]
        own = rows.join(F.broadcast(spark.createDataFrame([(k,) for k in whole], "source_key string")), "source_key", "left_semi")
        fresh = own.filter("head IS NOT NULL AND record_offset = begun").select("source_key", "head.*")
        waiting = rows.filter("latest").filter((F.col("__s.n_expected") > F.col("__s.pos")) & (F.col("__s.same") == 1)).select("source_key", "__s.h.*")
        mine = settled(fresh.unionByName(waiting).filter("fork IS NOT NULL OR base IS NOT NULL"), "lineage-heads", kept)
        if not mine.limit(1).count():
            return nothing
        every = {c.source_key: c for c in [*self.discover(), *candidates]}
        heads = settled(self._heads(self._parsed(read_lines(spark, list(every.values()), most=HEAD_BYTES, kept=kept)[0])), "all-heads", kept)
        links, parents = self._page_links(heads), self._fork_parents(mine, heads)
        pages = mine.filter("base IS NOT NULL").select(F.col("source_key").alias("node"))
        above = lineage.ancestors(links.select("child", "parent"), pages).unionByName(parents.filter("parent IS NOT NULL").select(F.col("parent").alias("node"))).distinct()
        above = settled(above, "ancestors-of-pages", kept)
        wanted = {r["node"] for r in above.collect()} - set(whole)  # the files that these candidates descend from
        lines, _, more = read_lines(spark, [every[k] for k in sorted(wanted)], kept=kept)
        theirs = self._parsed(lines)
        known = settled(theirs.unionByName(own.select(*theirs.columns)), "lineage-rows", kept)
        chain = links.join(above.withColumnRenamed("node", "child"), "child", "left_semi")
        seeds, broken = self._pages(chain, pages.withColumnRenamed("node", "source_key"), known, ends.unionByName(more).dropDuplicates(["source_key"]))
        replays, lost = self._forks(mine, parents, known.filter("count"))
        return seeds, replays, broken.unionByName(lost)

    @staticmethod
    def _fork_parents(mine: DataFrame, heads: DataFrame) -> DataFrame:
        """(source_key, parent) of forks: the file with the id that the fork names that began no later; of several, the largest key."""
        forks = mine.filter("fork IS NOT NULL AND base IS NULL").filter(~F.col("fork").eqNullSafe(F.col("id"))).select("source_key", "fork", "ms")
        theirs = heads.select(F.col("source_key").alias("parent"), F.col("id").alias("fork"), F.col("ms").alias("begun"))
        return sequences.latest_parent(forks, theirs, "fork", "ms", "begun", "source_key", "parent")

    def _forks(self, mine: DataFrame, parents: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(source_key, pos, expected, expected_count) of forks' replays, and (source_key, warning) of forks without a parent.
        A parent's reports up to the fork's time are what the fork may repeat."""
        forks = mine.filter("fork IS NOT NULL AND base IS NULL").select("source_key", "fork", "ms", "id")
        theirs = counts.select(F.col("source_key").alias("parent"), "record_offset", F.col("ms").alias("at"), F.struct("timestamp", "total", "last").alias("expected"))
        replay = parents.join(forks.select("source_key", "ms"), "source_key").join(theirs, "parent").filter(F.col("at") <= F.col("ms"))
        replay = sequences.positions(replay, ["source_key"], "record_offset").withColumn("expected_count", F.count(F.lit(1)).over(W.partitionBy("source_key")))
        matched = replay.select("source_key").distinct().withColumn("has", F.lit(True))
        lost = forks.join(parents, "source_key", "left").join(matched, "source_key", "left").filter("has IS NULL")
        text = (
            F.when(F.col("fork").eqNullSafe(F.col("id")), "this fork names itself as its parent; what it repeats could not be told")
            .when(F.col("parent").isNull(), F.format_string("the parent %s of this fork was not found; what it repeats could not be told", "fork"))
            .otherwise(F.format_string("the parent %s of this fork reports nothing before it; what it repeats could not be told", "fork"))
        )
        return replay.select("source_key", "pos", "expected", "expected_count"), lost.select("source_key", text.alias("warning"))

    @staticmethod
    def _page_links(heads: DataFrame) -> DataFrame:
        """(child, parent, cut, ordinals, thread, mode, parent_mode) for each page, by the rollout that it continues; a rollout
        of several files is the one of the smallest key."""
        rollouts = heads.withColumn("rollout", identity.rollout_id(F.col("source_key"))).filter("rollout IS NOT NULL").groupBy("rollout").agg(F.min("source_key").alias("parent"))
        pages = heads.filter("base IS NOT NULL").select(F.col("source_key").alias("child"), "mode", F.col("base.thread_id").alias("thread"), F.col("base.end_byte_offset").alias("cut"), F.col("base.end_ordinal_exclusive").alias("ordinals"))
        modes = heads.select(F.col("source_key").alias("parent"), F.col("mode").alias("parent_mode"))
        return pages.join(rollouts.withColumnRenamed("rollout", "thread"), "thread", "left").join(modes, "parent", "left")

    @staticmethod
    def _pages(links: DataFrame, pages: DataFrame, rows: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(source_key, seed): the counters at which a page begins, and (source_key, warning) of chains that can't be followed.

        A link is good if the parent's records before the cut end there, and all have ordinals below the cut's. The seed is
        the nearest ancestor's running counters at its cut.
        """
        cuts = links.filter("parent IS NOT NULL").select("child", F.col("parent").alias("source_key"), "cut", "ordinals")
        before = rows.join(cuts, "source_key").filter("record_offset < cut")
        facts = before.groupBy("child").agg(F.max(F.col("record_offset") + F.col("size")).alias("stop"), F.max(~F.col("ok")).alias("bad"), F.max(F.col("ordinal").isNull()).alias("bare"), F.max(F.col("ordinal") >= F.col("ordinals")).alias("crosses"))
        # The counters at the cut: the last total, and the increments that were reported without one since.
        told = before.filter("count").select("child", "record_offset", "total", "last")
        reset = F.col("total").isNotNull() | F.col("last").isNull()
        since = F.max(F.when(reset, F.struct("record_offset", "total"))).over(W.partitionBy("child"))
        told = told.withColumn("base", since).filter(F.col("base").isNull() | (F.col("record_offset") >= F.col("base.record_offset")))
        added = {c: F.coalesce(F.sum(F.when(~reset, F.col("last")[c])), F.lit(0)) for c in EVERY}
        held = told.groupBy("child").agg(F.first("base").alias("base"), F.max(~reset).alias("more"), *(x.alias(c) for c, x in added.items()))
        seed = F.when(F.col("base.total").isNotNull() | F.col("more"), F.struct(*((F.coalesce(F.col("base.total")[c], F.lit(0)) + F.col(c)).alias(c) for c in EVERY)).cast(_U))
        length = ends.select(F.col("source_key").alias("parent"), F.col("committed_offset").alias("length"))
        checked = links.join(facts, "child", "left").join(held.select("child", seed.alias("value")), "child", "left").join(length, "parent", "left")
        say = lambda text, *args: F.format_string(text, *args)
        problem = F.when(~F.coalesce(F.col("mode") == "paginated", F.lit(False)), "it continues another rollout but is not kept in pages").when(
            F.coalesce(F.col("ordinals"), F.lit(0)) == 0, "the cut in its parent is before the first record"
        )
        late = (
            F.when(F.col("parent").isNull(), say("its parent %s was not found", "thread"))
            .when(~F.coalesce(F.col("parent_mode") == "paginated", F.lit(False)), say("its parent %s is not kept in pages", "thread"))
            .when(F.col("stop") > F.col("cut"), say("the cut at byte %d is inside a record of the parent", "cut"))
            .when(F.coalesce("length", F.lit(0)) < F.col("cut"), say("the parent ends before the cut at byte %d", "cut"))
            .when(F.col("bad") | F.col("bare"), "a record of the parent before the cut has no ordinal")
            .when(F.col("crosses"), "a record of the parent before the cut has an ordinal beyond it")
        )
        found = lineage.resolve(checked.select("child", "parent", problem.alias("problem"), late.alias("late"), "value")).withColumnRenamed("child", "source_key").join(pages, "source_key", "left_semi")
        ring = F.when(F.col("cycle").isNotNull(), F.format_string("its ancestors form a cycle at %s", "cycle"))
        text = F.concat(F.lit("the pages before this one can't be followed: "), F.coalesce("problem", ring))
        return found.filter("value IS NOT NULL").select("source_key", F.col("value").alias("seed")), found.select("source_key", text.alias("warning")).filter("warning IS NOT NULL")
