"""Conversation prefix trie by heavy-path decomposition.

A node is a distinct sequence of first turns, known by its depth and by 128 bits: the XOR of two hashes of every turn with
its place. A prefix's bits are running XORs, so a node's parent is known without looking at its children, and texts are
left behind once they are digested.

Heavy paths: of a node's children the one with most members (ties: the smallest conv_id) goes on the node's path, every
other child is light and begins a path of its own. A light child has at most half of its parent's members, so that at most
log2(members) paths lie above a node. Within a path, subtree sums are suffix sums by depth; the sum of a path's top is
then added to its parent, which is on a path one level up. So the rounds go by level, each over the nodes of that level
alone, from the deepest level to the root's.

Nothing is gathered by conversation or node. Turns are ranked over a global sort (equal turns spread by chance), running
values are summed within cells of CELL places and carried over cells, and the conversations that end at a node meet in
sorted chunks of 4,096 ids at most, which one hash reads as a stream.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallywheel.llm._common import WORD, forget, written

CELL = 4096
ROOT_EVERY, MOST_HEAD = 20, 4
KEY = ("depth", "x1", "x2")
_FOLD = {"xor": F.bit_xor, "sum": F.sum, "max": F.max}


def _both(kind: str, a: Column, b: Column) -> Column:
    if kind == "max":
        return F.greatest(a, b)
    return a.bitwiseXOR(F.coalesce(b, F.lit(0))) if kind == "xor" else a + F.coalesce(b, F.lit(0))


def running(rows: DataFrame, by: list[str], at: str, folds: dict[str, tuple[str, str]], many: bool) -> DataFrame:
    """rows with running values: {name: (column, "xor" | "sum" | "max")} over the rows of `by` up to and with place `at`.

    Places are 0 and more; a window sees one cell of CELL places. `many` says that some `by` has more than one: then what cells hold is folded, and
    each cell gets the fold of those before it.
    """
    rows = rows.withColumn("__cell", F.floor(F.col(at) / CELL))
    within = W.partitionBy(*by, "__cell").orderBy(at).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = rows.withColumns({name: _FOLD[kind](col).over(within) for name, (col, kind) in folds.items()})
    if many:
        before = W.partitionBy(*by).orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)
        cells = rows.groupBy(*by, "__cell").agg(*(_FOLD[kind](col).alias(f"__{name}") for name, (col, kind) in folds.items()))
        carried = cells.select(*by, "__cell", *(_FOLD[kind](f"__{name}").over(before).alias(f"__{name}") for name, (_, kind) in folds.items()))
        out = out.join(carried, [*by, "__cell"], "left")
        out = out.withColumns({name: _both(kind, F.col(name), F.col(f"__{name}")) for name, (_, kind) in folds.items()}).drop(*(f"__{name}" for name in folds))
    return out.drop("__cell")


def ranked(conversations: DataFrame) -> DataFrame:
    """(conv_id, k, digest, words): the turns of each conversation numbered from 1, nulls first, ties by digest.

    The digest is the MD5 of role and text, the words are the text's. Turns are cut into ranges of a global sort; a turn's
    number is its place in its range and the turns that its conversation has in the ranges before.
    """
    spark = conversations.sparkSession
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    words = F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long")
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), words.alias("words"))
    rows = written(rows.withColumn("chance", F.rand(11)), "trie-turns")
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("chance")]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    sliced = written(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "trie-slices")
    counts = sliced.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    here = F.row_number().over(W.partitionBy("conv_id", "part").orderBy(*order[1:]))
    out = sliced.withColumn("here", here).join(before.select("conv_id", "part", "before"), ["conv_id", "part"])
    out = written(out.select("conv_id", (F.col("here") + F.col("before")).alias("k"), "digest", "words"), "trie-ranked")
    forget(rows, sliced)
    return out


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, conversations) of ranked turns: each conversation gets the first turns of its family's root before its own.

    rows: conv_id, depth, digest, words, ends (whether the conversation ends there); conversations: conv_id, size.
    """
    own = turns.groupBy("conv_id").agg(F.max("k").alias("n"))
    take = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(MOST_HEAD))
    own = own.withColumns({"h": take, "root": F.col("conv_id") - F.col("conv_id") % ROOT_EVERY})
    # Three turns at most of a root, for its twenty conversations at most.
    heads = turns.filter((F.col("k") < MOST_HEAD) & (F.col("conv_id") % ROOT_EVERY == 0)).groupBy(F.col("conv_id").alias("root")).agg(F.array_sort(F.collect_list(F.struct("k", "digest", "words"))).alias("head"))
    own = own.join(heads, "root", "left").withColumn("m", F.least(F.col("h"), F.coalesce(F.size("head"), F.lit(0)).cast("long")))
    own = own.withColumn("m", F.greatest("m", F.lit(0))).withColumn("size", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    own = written(own.select("conv_id", "h", "m", "size", F.when(F.col("m") > 0, F.slice("head", F.lit(1), F.col("m").cast("int"))).alias("head")), "trie-own")
    first = own.select("conv_id", "size", F.explode("head").alias("t")).select("conv_id", F.col("t.k").alias("depth"), F.col("t.digest").alias("digest"), F.col("t.words").alias("words"), "size")
    rest = turns.join(own.select("conv_id", "h", "m", "size"), "conv_id").filter("k > h").select("conv_id", (F.col("k") - F.col("h") + F.col("m")).alias("depth"), "digest", "words", "size")
    rows = first.unionByName(rest).select("conv_id", F.col("depth").cast("long").alias("depth"), "digest", "words", (F.col("depth") == F.col("size")).alias("ends"))
    return rows, own.select("conv_id", "size")


def chained_hash(ends: DataFrame) -> DataFrame:
    """(depth, x1, x2, conv_id) -> (depth, x1, x2, ends_sha256): the SHA-256 of each node's ids, ascending, joined by commas.

    Ids meet in chunks of consecutive values (4,096 distinct ids at most); a node's chunks come to one hash in order, as a
    stream, so that a node with many ids takes time and no memory.
    """
    chunk = F.shiftright("conv_id", 12)
    chunks = ends.groupBy(*KEY, chunk.alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    chunks = chunks.repartition(*KEY).sortWithinPartitions(*KEY, "chunk").select(*KEY, "ids")

    def run(batches):
        held = state = None

        def rows(keys, done):
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*keys, strict=True)), pa.array(done)], names=[*KEY, "ends_sha256"])

        for batch in batches:
            keys, done = [], []
            for *key, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if key != held:
                    if held is not None:
                        keys.append(held)
                        done.append(state.hexdigest())
                    held, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            if keys:
                yield rows(keys, done)
        if held is not None:
            yield rows([held], [state.hexdigest()])

    return chunks.mapInArrow(run, "depth long, x1 long, x2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 for each node of the trie.

    Null roles and texts are empty ones; a null turn comes first; turns that tie come in order of the MD5 of their role and
    text; a row that repeats another is a turn of its own; rows without a conv_id take no part; other columns are not looked
    at. An empty table has no node. Long conversations and texts are read whole.
    """
    rows, convs = rebuilt(ranked(conversations))
    rows = written(rows, "trie-rebuilt")
    deepest = convs.agg(F.max("size")).first()[0]
    if deepest is None:
        return rows.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    many = deepest >= CELL
    bits = {f"h{i}": F.xxhash64(F.lit(i), "depth", "digest") for i in (1, 2)}
    occ = running(rows.withColumns(bits).drop("digest"), ["conv_id"], "depth", {"x1": ("h1", "xor"), "x2": ("h2", "xor")}, many)
    occ = written(occ.withColumns({"p1": F.col("x1").bitwiseXOR(F.col("h1")), "p2": F.col("x2").bitwiseXOR(F.col("h2"))}).drop("h1", "h2"), "trie-rows")
    forget(rows)
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).select(*(zero.alias(c) for c in (*KEY, "p1", "p2", "words")), "conv_id", "n_convs")
    nodes = occ.groupBy(*KEY).agg(F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("words").alias("words"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    nodes = written(nodes.unionByName(root), "trie-nodes")
    heavy = F.max(F.struct("n_convs", -F.col("conv_id"), "x1", "x2")).alias("heavy")
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(F.count(F.lit(1)).alias("n_children"), heavy)
    family = written(nodes.join(children, list(KEY), "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-family")
    parent = family.filter("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("heavy.x1").alias("y1"), F.col("heavy.x2").alias("y2"))
    told = family.drop("heavy").join(parent, ["depth", "p1", "p2"], "left")
    told = written(told.withColumn("light", ~((F.col("x1") == F.col("y1")) & (F.col("x2") == F.col("y2"))) & (F.col("depth") > 0)).drop("y1", "y2"), "trie-told")
    # The top of a node's path is the last light node on the way to it, its level the number of light ones; any member's turns
    # lead to it, so the smallest member's do.
    lights = occ.join(told.select(*KEY, "light", F.col("conv_id").alias("least")), list(KEY)).withColumns({"top": F.when(F.col("light"), F.struct(*KEY)), "n": F.col("light").cast("long")})
    paths = running(lights.select("conv_id", *KEY, "least", "top", "n"), ["conv_id"], "depth", {"top": ("top", "max"), "level": ("n", "sum")}, many)
    paths = paths.filter("conv_id = least").select(*KEY, "top", "level")
    placed = told.join(paths, list(KEY), "left").withColumns({"level": F.coalesce("level", F.lit(0)), "top": F.coalesce("top", F.struct(*(zero.alias(c) for c in KEY))), "down": F.lit(deepest) - F.col("depth")})
    placed = written(placed.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")}), "trie-placed")
    level, below, levels = placed.agg(F.max("level")).first()[0], None, []
    while level >= 0:  # log2 of the conversations at most
        mine = placed.filter(F.col("level") == level)
        if below is not None:
            tops = below.filter((F.col("depth") == F.col("top.depth")) & (F.col("depth") > 0))
            more = tops.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(F.sum("n_leaves").alias("a"), F.sum("saved_tokens").alias("b"))
            mine = mine.join(more, list(KEY), "left").withColumns({"leaf": F.col("leaf") + F.coalesce("a", F.lit(0)), "saved": F.col("saved") + F.coalesce("b", F.lit(0))}).drop("a", "b")
        below = written(running(mine, ["top"], "down", {"n_leaves": ("leaf", "sum"), "saved_tokens": ("saved", "sum")}, many), "trie-level")
        levels.append(below)
        level -= 1
    out = levels[0]
    for df in levels[1:]:
        out = out.unionByName(df)
    none = convs.filter("size = 0").select(*(zero.alias(c) for c in KEY), "conv_id")
    hashes = chained_hash(occ.filter("ends").select(*KEY, "conv_id").unionByName(none))
    out = out.join(hashes, list(KEY), "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: The nodes in DuckDB: a node is the text of its turns' digests; a node counts for each prefix of its smallest member.
ORACLE = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS k,
         md5(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS g,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS w
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS root, n,
         xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda b: list_prepend(ascii(b)::BIGINT, [-1, -1, -1, -1, -1, -1, -1, -1])))),
             lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a // 2, 3988292384 * (a % 2)) END), 4294967295) % 4 AS h
  FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id)
), s AS (
  SELECT c.conv_id, t.k, 0 AS own, g, w FROM c JOIN t ON t.conv_id = c.root AND t.k <= c.h
  UNION ALL SELECT c.conv_id, t.k, 1, g, w FROM c JOIN t ON t.conv_id = c.conv_id AND t.k > c.h
), o AS (
  SELECT conv_id, row_number() OVER q AS depth, string_agg(g, '') OVER q AS p, w FROM s WINDOW q AS (PARTITION BY conv_id ORDER BY own, k ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT conv_id, 0, '', 0 FROM c
), e AS (SELECT conv_id, max(depth) AS size FROM o GROUP BY conv_id),
n AS (
  SELECT depth, p, min(o.conv_id) AS conv_id, count(*) AS n_convs, max(w) AS w,
         sha256(coalesce(string_agg(o.conv_id::VARCHAR, ',' ORDER BY o.conv_id) FILTER (WHERE size = depth), '')) AS ends_sha256
  FROM o JOIN e USING (conv_id) GROUP BY depth, p
), k AS (
  SELECT a.conv_id AS parent_conv_id, b.depth, b.p, count(*) OVER (PARTITION BY a.depth, a.p) AS siblings
  FROM n b JOIN n a ON a.depth = b.depth - 1 AND a.p = left(b.p, 32 * (b.depth::INT - 1))
), m AS (SELECT n.*, parent_conv_id, coalesce((SELECT max(siblings) FROM k WHERE k.depth = n.depth + 1 AND left(k.p, 32 * n.depth::INT) = n.p), 0) AS n_children FROM n LEFT JOIN k USING (depth, p)),
u AS (
  SELECT a.depth, a.p, sum((v.n_children = 0)::BIGINT) AS n_leaves, sum((v.n_convs - 1) * v.w) AS saved_tokens
  FROM m v JOIN o a ON a.conv_id = v.conv_id AND a.depth <= v.depth GROUP BY a.depth, a.p
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256 FROM m JOIN u USING (depth, p)
"""
