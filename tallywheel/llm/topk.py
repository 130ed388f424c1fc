"""Exact top-k by inner product: dual-tree search over cover trees.

Vectors are indexed in blocks: the nearest of a sample of pivots (split further by hash where a pivot's cell is large)
decides the block, and each block is a cover tree. Queries are cut into chunks with a tree each. In a pair of nodes no
inner product exceeds

    cq . cv + rq |cv| + rv |cq| + rq rv        (centres c, covering radii r)

so the pair is pruned if that is below the worst k-th score of the query node's queries. The roots are the first pairs:
their centres and radii decide which chunk meets which block before any tree is sent. Every query starts with its k-th score over the pivot sample, which is a lower bound of the true one. The result is exact; the sample only decides
how much is pruned.

Copies of a vector are one point that carries its k + 1 smallest ids (one may be the query's own), cut before the
shuffle, so a vector that a third of all rows share is no hot group.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallywheel.llm._common import written

LEAF, TINY = 128, 24
SAMPLE, PIVOTS = 1024, 64
BLOCK_ROWS, CHUNK_ROWS = 4096, 1024
#: Chunks grow beyond CHUNK_ROWS rather than in number, so that their roots stay a small broadcast.
MOST_CHUNKS = 4096
#: Chunks that meet a block in one task, one after another.
TOGETHER = 32
SLACK = 1e-6


class CoverTree:
    """A cover tree over the rows of x: each node's points lie within its radius of its centre, each child's centre lies
    within half of it unless the child gathers stragglers. Clusters of fewer than TINY points are gathered, so that the
    number of nodes stays far below the number of points."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.centre, self.radius, self.children, self.points = [], [], [], []
        if len(x):
            self._build(np.arange(len(x)), 0)
        self.centre = np.array(self.centre, np.int64)
        self.radius = np.array(self.radius)
        self.norm = np.sqrt((x[self.centre] ** 2).sum(1)) if len(x) else np.zeros(0)

    def _node(self, centre: int, members: np.ndarray) -> int:
        away = np.sqrt(((self.x[members] - self.x[centre]) ** 2).sum(1))
        self.centre.append(centre)
        self.radius.append(float(away.max()))
        self.children.append([])
        self.points.append(members)
        return len(self.centre) - 1

    def _build(self, members: np.ndarray, centre: int) -> None:
        todo = [self._node(centre, members)]
        while todo:
            node = todo.pop()
            members, radius = self.points[node], self.radius[node]
            if len(members) <= LEAF or radius == 0:
                continue
            left, at, rest = members, self.centre[node], []
            while len(left):
                near = ((self.x[left] - self.x[at]) ** 2).sum(1) <= (radius / 2) ** 2
                near[left == at] = True
                own, left = left[near], left[~near]
                if len(own) < TINY:
                    rest.append(own)
                else:
                    self.children[node].append(self._node(at, own))
                at = left[0] if len(left) else -1
            todo += self.children[node]
            rest = np.concatenate(rest) if rest else np.zeros(0, np.int64)
            for i in range(0, len(rest), LEAF):
                self.children[node].append(self._node(int(rest[i]), rest[i : i + LEAF]))


def may_reach(dots, rq, rv, q_norm, v_norm, floors) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, whether each pair of nodes may hold a score that reaches its floor), from the inner products of the
    centres, the radii and the norms. Rounding must not prune: the tolerance widens the bound whatever its sign."""
    bound = dots + rq * v_norm + rv * q_norm + rq * rv
    return bound, bound + SLACK * np.abs(bound) + SLACK * 1e3 >= floors


def best_of_pairs(queries: CoverTree, query_ids: np.ndarray, worst: np.ndarray, data: CoverTree, ids: list, k: int):
    """(query, id, score) arrays: of each query the k best within data that reach its worst score so far (worst is raised)."""
    held: dict[int, list[tuple[float, int]]] = {}
    stack = [(0, 0)] if len(queries.centre) and len(data.centre) else []
    while stack:
        a, b = stack.pop()
        own = queries.points[a]
        floor = worst[own].min()
        if queries.children[a] and (queries.radius[a] >= data.radius[b] or not data.children[b]):
            pairs = [(c, b) for c in queries.children[a]]
        elif data.children[b]:
            pairs = [(a, c) for c in data.children[b]]
        else:
            scores = queries.x[own] @ data.x[data.points[b]].T
            for i, j in zip(*np.nonzero(scores >= worst[own, None]), strict=True):
                q, s = int(own[i]), float(scores[i, j])
                if s < worst[q]:
                    continue
                mine = held.setdefault(q, [])
                mine += [(-s, x) for x in ids[data.points[b][j]] if x != query_ids[q]]
                if len(mine) >= 4 * k:
                    mine.sort()
                    del mine[k:]
                    worst[q] = max(worst[q], -mine[-1][0])
            continue
        qa, vb = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
        dots = (queries.x[queries.centre[qa]] * data.x[data.centre[vb]]).sum(1)
        rq, rv = queries.radius[qa], data.radius[vb]
        floors = np.array([worst[queries.points[p]].min() for p in qa]) if len(set(qa.tolist())) > 1 else np.full(len(pairs), floor)
        bound, fit = may_reach(dots, rq, rv, queries.norm[qa], data.norm[vb], floors)
        stack += [pairs[i] for i in np.argsort(bound) if fit[i]]  # the most promising pair is next
    out = [(int(query_ids[q]), x, int(-s)) for q, mine in held.items() for s, x in sorted(mine)[:k]]
    return out


def whole_vectors(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component; vectors that are null or hold null or non-finite components, and rows without an id, left out."""
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = vectors.filter(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(ok, F.lit(False)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"))


def _matrix(lists, width: int) -> np.ndarray:
    """Rows of integers as doubles; a shorter vector's missing components are 0."""
    lists = list(lists)
    if lists and all(len(v) == width for v in lists):
        return np.array(lists, np.float64).reshape(len(lists), width)
    out = np.zeros((len(lists), width))
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best by inner product for each vector whose id is divisible by `every`.

    Ties go to the smaller vec_id; a query's own id is no candidate; rows that repeat an id and vector count once. With
    fewer than k candidates all are returned. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = written(whole_vectors(vectors, scale).distinct(), "topk-vectors")  # a row that is repeated often is one
    few = F.dense_rank().over(W.partitionBy("v").orderBy("vec_id"))
    points = rows.withColumn("n", few).filter(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    points = written(points, "topk-points")
    width = points.agg(F.max(F.size("v"))).first()[0] or 0
    sample = points.orderBy(F.xxhash64("v"), "v").limit(SAMPLE).collect()  # SAMPLE rows at most
    shared = spark.sparkContext.broadcast((_matrix((r["v"] for r in sample), width), [list(r["ids"]) for r in sample]))

    def cells(batches):
        x, _ = shared.value
        pivots = x[:PIVOTS]
        for batch in batches:
            v = _matrix(batch.column("v").to_pylist(), width)
            away = (pivots**2).sum(1)[None, :] - 2 * v @ pivots.T
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(away.argmin(1).astype(np.int32))], names=[*batch.schema.names, "cell"])

    def parts(df: DataFrame, size: int) -> DataFrame:
        """df with part: cells split by hash to about `size` rows, small cells gathered."""
        counts = {r["cell"]: r["count"] for r in df.groupBy("cell").count().collect()}  # PIVOTS rows at most
        first, number, room = {}, 0, 0
        for cell, n in sorted(counts.items()):
            splits = -(-n // size)
            if splits > 1 or n > room:
                number, room = number + 1, size - n
                first[cell] = (number, splits)
                if splits > 1:
                    number, room = number + splits - 1, 0
            else:
                first[cell], room = (number, 1), room - n
        plan = spark.createDataFrame([(c, a, s) for c, (a, s) in first.items()], "cell int, a int, s int")
        return df.join(F.broadcast(plan), "cell").withColumn("part", (F.col("a") + F.pmod(F.xxhash64("v"), F.col("s"))).cast("int"))

    celled = written(points.mapInArrow(cells, "v array<bigint>, ids array<bigint>, cell int"), "topk-celled")

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = CoverTree(_matrix(pdf["v"], width))
        return pd.DataFrame({"block": [pdf["part"].iloc[0]], "centre": [tree.x[tree.centre[0]].tolist()], "radius": [tree.radius[0]], "tree": [pickle.dumps((tree, [[int(i) for i in x] for x in pdf["ids"]]))]})

    blocks = written(parts(celled, BLOCK_ROWS).groupBy("part").applyInPandas(index, "block int, centre array<double>, radius double, tree binary"), "topk-index")
    wanted = rows.filter(F.col("vec_id") % every == 0).mapInArrow(cells, "vec_id bigint, v array<bigint>, cell int")

    def chunk(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids = shared.value
        mine = pdf["vec_id"].to_numpy()
        tree = CoverTree(_matrix(pdf["v"], width))
        worst = np.full(len(pdf), -np.inf)
        scores = tree.x @ x.T
        for i in range(len(pdf)):  # the k-th score over the sample's points, each without the query's own id
            order = np.argsort(-scores[i])[: 2 * k + 1]
            got = [scores[i, j] for j in order for y in ids[j] if y != mine[i]]
            if len(got) >= k:
                worst[i] = got[k - 1]
        return pd.DataFrame({"chunk": [pdf["part"].iloc[0]], "centre": [tree.x[tree.centre[0]].tolist()], "radius": [tree.radius[0]], "floor": [worst.min()], "queries": [pickle.dumps((tree, mine, worst))]})

    asked = written(wanted, "topk-queries")
    size = max(CHUNK_ROWS, -(-asked.count() // MOST_CHUNKS))
    chunks = written(parts(asked, size).groupBy("part").applyInPandas(chunk, "chunk int, centre array<double>, radius double, floor double, queries binary"), "topk-chunks")
    heads = chunks.select("chunk", "centre", "radius", "floor").collect()  # MOST_CHUNKS + PIVOTS rows at most, about
    if not heads:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    roots = spark.sparkContext.broadcast((np.array([r["chunk"] for r in heads], np.int32), _matrix((r["centre"] for r in heads), width), np.array([r["radius"] for r in heads]), np.array([r["floor"] for r in heads])))

    def pair(batches):
        numbers, centres, rq, floors = roots.value
        norms = np.sqrt((centres**2).sum(1))
        for batch in batches:
            for block, centre, rv in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                centre = np.array(centre)
                met = numbers[may_reach(centres @ centre, rq, rv, norms, np.sqrt((centre**2).sum()), floors)[1]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(met), block, np.int32)), pa.array(met)], names=["block", "chunk"])

    pairs = written(blocks.select("block", "centre", "radius").mapInArrow(pair, "block int, chunk int"), "topk-pairs")

    def meet(batches):
        data = ids = None
        for batch in batches:
            for tree, queries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if tree is not None:  # stands before the chunks that it meets
                    data, ids = pickle.loads(tree)
                    continue
                chunk_tree, mine, worst = pickle.loads(queries)
                found = best_of_pairs(chunk_tree, mine, worst.copy(), data, ids, k)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["query_id", "vec_id", "score"])

    # A tree is sent once for TOGETHER chunks, which follow it as a stream; what a task holds is one tree and one chunk.
    met = pairs.withColumn("lot", F.floor(F.col("chunk") / TOGETHER))
    trees = met.select("block", "lot").distinct().join(blocks.select("block", "tree"), "block").select("block", "lot", F.lit(-1).alias("chunk"), "tree", F.lit(None).cast("binary").alias("queries"))
    asks = met.join(chunks.select("chunk", "queries"), "chunk").select("block", "lot", "chunk", F.lit(None).cast("binary").alias("tree"), "queries")
    lots = max(1, min(20_000, met.select("block", "lot").distinct().count()))
    stream = trees.unionByName(asks).repartition(lots, "block", "lot").sortWithinPartitions("block", "lot", "chunk").select("tree", "queries")
    found = stream.mapInArrow(meet, "query_id bigint, vec_id bigint, score bigint").distinct()
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: The rows in DuckDB: k 5, every 50, scale 256.
ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
