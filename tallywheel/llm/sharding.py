"""Balanced label propagation: documents into shards of equal counts, linked documents together (DataFrame functions only).

Linked are documents of equal text; the text's hash is the hub that links them, so a group of n copies is n links, not
n * n. A group's state is one row: how many of its documents stand in each shard. Each round, every group proposes to
move towards the shard where most of it stands; proposals are summed by (shard, gain) and a shard accepts them in
order of gain until its quota (its room, and what others leave) is full. Groups larger than a shard fill one after another.

After the last round documents without links fill the shards up; then all rows stand in one line by shard and are cut
at equal counts. Within a shard the unlinked documents stand at both ends, so a cut that has to shift moves them
before it splits a group. Line positions are cell counts plus a row number within a cell, never a global sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallywheel.llm._common import as_row, forget, written

HUB = ["__hub", "__size", "__crc"]
INNER = [*HUB, "__linked", "__unit"]


def keyed(docs: DataFrame) -> DataFrame:
    """docs with __size (UTF-8 bytes and 1), __crc (unsigned), __hub (the text's hash; a row without a text
    has no links: __linked is false, and its hub is its id's hash, so that such rows spread) and __unit (a row's hash)."""
    text = F.col("text")
    return docs.withColumns({
        "__size": (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long"),
        "__crc": F.crc32(F.coalesce(text, F.lit("")).cast("binary")),
        "__linked": text.isNotNull(),
        "__hub": F.when(text.isNotNull(), F.xxhash64(text)).otherwise(F.xxhash64(F.col("doc_id").cast("string"), F.lit("-"))),
        "__unit": F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), text),
    })


def _share(unit: Column, salt: int) -> Column:
    """A row's place in [0, 1)."""
    return (F.pmod(F.xxhash64(unit, F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))).cast("double")


def propagate(rows: DataFrame, shards: int, capacity: float, rounds: int = 24) -> tuple[DataFrame, list[float]]:
    """The groups' state (hub columns, total, c: documents in each shard) after balanced label propagation, and the load of each shard."""
    home = F.pmod(F.xxhash64("__unit", F.lit(1)), F.lit(shards))
    counts = [F.count(F.when(home == i, 1)).alias(f"c{i}") for i in range(shards)]
    groups = rows.filter("__linked").groupBy(*HUB).agg(F.count(F.lit(1)).alias("total"), *counts).filter("total > 1")
    state = written(groups.select(*HUB, "total", F.array(*(f"c{i}" for i in range(shards))).alias("c")), "shard-groups")

    def load() -> list[float]:
        got = state.agg(*(F.sum(F.col("c")[i]).alias(f"c{i}") for i in range(shards))).first()
        return [float(x or 0) for x in got]

    full = load()
    for number in range(rounds):
        room = [max(0.0, capacity - x) for x in full]
        open_ = F.array(*(F.lit(x >= 1) for x in room))
        big = F.col("total") > capacity
        # Ties between shards are broken by a hash, so that no shard is everyone's choice. Small groups may choose any
        # shard, as others leave it in the same round; a group larger than a shard chooses one with room.
        inside = F.zip_with("c", F.sequence(F.lit(0), F.lit(shards - 1)), lambda n, i: F.when((n > 0) & (~big | F.get(open_, i)), n * 1024 + F.pmod(F.xxhash64("__hub", i), F.lit(1024))).otherwise(F.lit(-1).cast("long")))
        plan = state.withColumn("o", inside).withColumn("top", F.array_max("o")).filter("top >= 0")
        plan = plan.withColumns({"to": (F.array_position("o", F.col("top")) - 1).cast("int"), "best": F.floor(F.col("top") / 1024)})
        leaving = F.zip_with("o", F.sequence(F.lit(0), F.lit(shards - 1)), lambda n, i: F.when((n > 0) & (i != F.col("to")), F.floor(n / 1024)).otherwise(F.lit(0)).cast("long"))
        plan = plan.withColumn("leaving", leaving).withColumn("moves", F.aggregate("leaving", F.lit(0).cast("long"), lambda a, n: a + n)).filter("moves > 0")
        plan = plan.withColumn("gain", F.least(F.lit(60), F.floor(F.log2(F.col("best") + 1.0) * 2)).cast("int"))
        outs = [F.sum(F.col("leaving")[i]).alias(f"out{i}") for i in range(shards)]
        asked = plan.groupBy("to", "gain").agg(F.sum("moves").alias("moves"), *outs).collect()  # shards * 61 rows at most
        if not asked:
            break
        # What leaves a shard makes room for what comes.
        room = [capacity - x + sum(r[f"out{i}"] for r in asked) for i, x in enumerate(full)]
        taken, left = [], list(room)
        for r in sorted(asked, key=lambda r: (r["to"], -r["gain"])):
            part = min(1.0, max(0.0, left[r["to"]]) / r["moves"])
            left[r["to"]] -= part * r["moves"]
            taken.append((r["to"], r["gain"], part))
        quota = rows.sparkSession.createDataFrame(taken, "to int, gain int, part double")
        sure = (F.col("part") >= 1) | (F.col("moves") >= 64) | (F.col("total") > capacity) | (_share(F.col("__hub"), 100 + number) < F.col("part"))
        some = F.when(F.col("part") >= 1, 1.0).when((F.col("moves") >= 64) | (F.col("total") > capacity), F.col("part")).otherwise(1.0)
        chosen = plan.join(F.broadcast(quota), ["to", "gain"]).filter(sure).select(*HUB, "to", some.alias("part"), "moves", F.lit(True).alias("go"))
        moved = state.join(chosen.hint("merge"), HUB, "left")
        leaves = F.transform("c", lambda n, i: F.when((i != F.col("to")) & ((F.col("total") <= capacity) | F.get(open_, i)), F.when(F.col("total") > capacity, F.ceil(n * F.col("part"))).otherwise(F.floor(n * F.col("part")))).otherwise(F.lit(0)).cast("long"))
        moved = moved.withColumn("leaves", leaves)
        arrive = F.aggregate("leaves", F.lit(0).cast("long"), lambda a, n: a + n)
        after = F.transform("c", lambda n, i: n - F.col("leaves")[i] + F.when(i == F.col("to"), arrive).otherwise(F.lit(0).cast("long")))
        new = written(moved.select(*HUB, "total", F.when(F.col("go"), after).otherwise(F.col("c")).alias("c")), "shard-groups")
        forget(state)
        state, before = new, full
        full = load()
        if before == full and number:
            break
    # Groups that the quotas left divided settle where most of them stands: the last cut at equal counts shifts by so much.
    best = F.array_position("c", F.array_max("c")) - 1
    settled = F.transform("c", lambda n, i: F.when(F.col("total") > capacity, n).when(i == best, F.col("total")).otherwise(F.lit(0).cast("long")))
    new = written(state.select(*HUB, "total", settled.alias("c")), "shard-groups")
    forget(state)
    state = new
    return state, load()


def apart(rows: DataFrame, most: int) -> DataFrame:
    """rows where those that repeat an id and a text more than `most` times have units of their own, so that they spread over
    cells: they are alike, so that any of them may stand anywhere. The draw is written, as counts and ranks must see the same."""
    many = written(rows.groupBy("__unit").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select(F.col("__unit").alias("many")), "shard-many")
    if not many.limit(1).count():
        return rows
    out = rows.join(many, F.col("__unit") == F.col("many"), "left")
    return written(out.withColumn("__unit", F.when(F.col("many").isNotNull(), F.xxhash64("__unit", F.floor(F.rand(3) * (1 << 40)))).otherwise(F.col("__unit"))).drop("many"), "shard-apart")


def assign(rows: DataFrame, shards: int = 16, total: int | None = None, rounds: int = 24) -> DataFrame:
    """rows (as keyed() gives them) with shard and slot (gapless from 0 in each shard); shard counts differ by one at most."""
    total = rows.count() if total is None else total
    plain = [c for c in rows.columns if c not in INNER]
    if not total:
        return rows.select(*plain, "__size", "__crc", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    capacity = total / shards
    cell_rows = max(128, min(1_000_000, total // 2000))
    rows = apart(rows, cell_rows)
    state, load = propagate(rows, shards, capacity, rounds)
    # A group's documents are dealt to its shards by their place in [0, 1).
    ends = F.transform("c", lambda n, i: F.aggregate(F.slice("c", 1, i + 1), F.lit(0).cast("long"), lambda a, x: a + x) / F.col("total"))
    alloc = state.select(*HUB, F.col("total").alias("__total"), ends.alias("__ends"))
    total_of = F.when(F.col("__linked"), F.col("__total"))
    need = [max(0.0, capacity - x) for x in load]
    edges, at = [], 0.0
    for x in need:
        at += x / (sum(need) or 1.0)
        edges.append(at)
    edges[-1] = 2.0
    place = _share(F.col("__unit"), 2)
    first = lambda ends: F.least(F.lit(shards - 1), F.size(F.filter(ends, lambda e: e <= place)))
    label = F.when(total_of.isNotNull(), first(F.col("__ends"))).otherwise(first(F.array(*(F.lit(e) for e in edges)))).cast("int")
    buckets = max(1, total // (shards * cell_rows))
    side = F.when(total_of.isNotNull(), 1).when(_share(F.col("__unit"), 3) < 0.5, 0).otherwise(2)
    bucket = F.when(total_of.isNotNull(), F.pmod(F.xxhash64("__hub", F.lit(4)), F.lit(buckets))).otherwise(F.pmod(F.xxhash64("__unit", F.lit(4)), F.lit(buckets)))
    salt = F.when(total_of > cell_rows, F.pmod(F.xxhash64("__unit", F.lit(5)), F.ceil(total_of / cell_rows))).otherwise(0)
    cell = ["__label", "__side", "__bucket", "__salt"]
    lined = rows.join(alloc.hint("merge"), HUB, "left").withColumns({"__label": label, "__side": side, "__bucket": bucket.cast("long"), "__salt": salt.cast("long")})
    cells = written(lined.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")), "shard-cells")
    labels = {r["__label"]: r["n"] for r in cells.groupBy("__label").agg(F.sum("n").alias("n")).collect()}  # a row a shard
    begins = [sum(labels.get(j, 0) for j in range(i)) for i in range(shards)]
    start = F.sum("n").over(W.partitionBy("__label").orderBy("__side", "__bucket", "__salt")) - F.col("n")
    start = start + F.element_at(F.array(*(F.lit(b).cast("long") for b in begins)), F.col("__label") + 1)
    starts = cells.select(*cell, start.alias("__start"))
    order = W.partitionBy(*cell).orderBy(*HUB, "__unit")
    rank = F.row_number().over(order) - 1 + F.col("__start")
    ranked = lined.join(starts.hint("merge"), cell).withColumn("__rank", rank)
    each, more = divmod(total, shards)
    edge = more * (each + 1)
    r = F.col("__rank")
    shard = F.when(r < edge, F.floor(r / (each + 1))).otherwise(more + F.floor((r - edge) / max(each, 1)))
    slot = F.when(r < edge, r % (each + 1)).otherwise((r - edge) % max(each, 1))
    return ranked.select(*plain, "__size", "__crc", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """The columns of docs with shard and slot.

    Null texts have no links and size 1; empty texts are equal texts and link. Repeated rows, ties and null ids are rows
    like any other; long texts are hashed whole. Columns of docs named shard or slot are replaced, those of any other name
    are carried as they are. An empty table gives an empty result.
    """
    rows = keyed(docs.select(as_row(docs, ("shard", "slot")), "doc_id", "text"))
    return assign(rows.drop("doc_id", "text"), shards, docs.count()).select("row.*", "shard", "slot")


def shard_report(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law (rows), shard, slot, grown_shard (null: the law isn't key), cut_links: how many documents of
    the same text are in other shards (each a link that is cut; the sum counts each link from both ends)."""
    rows = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).drop("text")
    rows = written(rows.withColumn("linked_by", F.when(F.col("__linked"), F.struct(*HUB))), "shard-rows")
    out = written(assign(rows, shards), "shard-assigned")
    inside = out.filter("linked_by IS NOT NULL").groupBy("linked_by", "shard").agg(F.count(F.lit(1)).alias("here"))
    inside = inside.withColumn("cut", F.sum("here").over(W.partitionBy("linked_by")) - F.col("here")).filter("cut > 0")  # a row a shard, at most
    out = out.join(inside.select("linked_by", "shard", "cut"), ["linked_by", "shard"], "left")
    return out.select("doc_id", F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.coalesce("cut", F.lit(0)).cast("long").alias("cut_links"))
