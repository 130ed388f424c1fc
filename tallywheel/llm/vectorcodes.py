"""Vector code compression: a codebook for each part of the vectors, the nearest entry found by partial-distance search.

Components become integers, so that every distance is exact and every run agrees. A vector is cut into equal consecutive
parts; a part position has a codebook of integer entries that Lloyd rounds move. In a round each task assigns its parts
and sends one row for each (part, entry) it used: a count and sums. What meets in one place is the codebooks alone, which
grow with neither rows nor tasks.

Partial-distance search looks at the components in descending order of the codebook's variance. All (row, entry) pairs
of a batch are held in arrays; after each component a mask drops the pairs whose sum so far is strictly above the best
complete distance that their row has (an entry that ties stays, so that ties are settled by index alone). A row's first
complete distance is to the entry nearest in the first component; half way the leading entry of each row is completed, too.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywheel.llm._common import written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096.0
#: Integer components are held within +-LIMIT, so that squared distances of thousands of components fit in 64 bits.
LIMIT = 1 << 24
#: Rows whose (row, entry) pairs are in memory at once.
ROWS = 4096


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x (n, d) the index of the nearest row of entries (k, d) by squared distance, ties to the lower
    index, and that distance."""
    n, (k, d) = len(x), entries.shape
    order = np.argsort(-entries.astype(np.float64).var(0), kind="stable")
    if not n or not d:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    first = (x[:, order[0], None] - entries[None, :, order[0]]) ** 2

    def complete(rows: np.ndarray, guess: np.ndarray) -> np.ndarray:
        return ((x[rows] - entries[guess]) ** 2).sum(1)

    best = complete(np.arange(n), first.argmin(1))
    row, entry = np.nonzero(first <= best[:, None])
    so_far = first[row, entry]
    for step, at in enumerate(order[1:], 1):
        so_far += (x[row, at] - entries[entry, at]) ** 2
        if 2 * step == d:
            # Of each row the pair that leads, completed, lowers what the others may reach.
            lead = np.lexsort((so_far, row))
            lead = lead[np.r_[True, row[lead][1:] != row[lead][:-1]]]
            best[row[lead]] = np.minimum(best[row[lead]], complete(row[lead], entry[lead]))
        stay = so_far <= best[row]
        row, entry, so_far = row[stay], entry[stay], so_far[stay]
    # The pairs left are complete: per row the least distance, then the lowest index.
    least = np.lexsort((entry, so_far, row))
    least = least[np.r_[True, row[least][1:] != row[least][:-1]]]
    return entry[least], so_far[least]


def _parts(column: pa.Array, width: int, parts: int) -> np.ndarray:
    """A batch's vectors as integers (rows, parts, width of a part); a shorter vector's missing components are 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()]
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out.reshape(len(sizes), parts, width // parts)


def whole(vectors: DataFrame, scale: float = SCALE) -> DataFrame:
    """(vec_id, label, v): the integer components; rows whose vector is null or holds null or non-finite components left out."""
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = vectors.filter(F.col("embedding").isNotNull() & F.coalesce(ok, F.lit(False)))
    clipped = F.transform("embedding", lambda x: F.floor(F.greatest(F.least(F.lit(scale) * x.cast("double"), F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("int"))
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int").alias("label")
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), label, clipped.alias("v"))


def start(rows: DataFrame, width: int, parts: int, entries: int) -> list[np.ndarray]:
    """The first codebooks, (k, width of a part) each: the parts of the vectors with the smallest ids, ascending."""
    first = rows.filter("vec_id IS NOT NULL").orderBy("vec_id", "v").limit(entries).select("v").collect()  # `entries` rows at most
    if not first:
        first = rows.orderBy("v").limit(entries).select("v").collect()
    x = np.zeros((len(first), width), np.int64)
    for i, r in enumerate(first):
        x[i, : len(r["v"])] = r["v"]
    return list(x.reshape(len(first), parts, width // parts).transpose(1, 0, 2).copy())


def step(rows: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """One Lloyd round: each entry becomes the floor of the mean of the parts nearest to it; unused entries stay."""
    parts = len(books)

    def sums(batches):
        count = np.zeros((parts, len(books[0])), np.int64)
        total = np.zeros((parts, *books[0].shape), np.int64)
        for batch in batches:
            x = _parts(batch.column(0), width, parts)
            for i in range(0, len(x), ROWS):
                for p, book in enumerate(books):
                    mine = x[i : i + ROWS, p]
                    found, _ = nearest(mine, book)
                    count[p] += np.bincount(found, minlength=len(book))
                    np.add.at(total[p], found, mine)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e], pa.int64()), pa.array(total[p, e].tolist(), pa.list_(pa.int64()))], names=["p", "e", "n", "s"])

    d = books[0].shape[1]
    each = rows.select("v").mapInArrow(sums, "p int, e int, n long, s array<long>")
    found = each.groupBy("p", "e").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("s")[i].cast("decimal(38,0)")) for i in range(d))).alias("s"))
    new = [book.copy() for book in books]
    for r in found.collect():  # parts * entries rows at most
        new[r["p"]][r["e"]] = [int(s) // r["n"] for s in r["s"]]
    return new


def codebooks_text(books: list[np.ndarray]) -> str:
    return ",".join(str(int(c)) for book in books for c in book.ravel())


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """((vec_id, label, codes array<int>, error), codebooks): every kept vector's entry for each part, and its squared distance.

    The first codebooks are the vectors of the smallest ids (rows that repeat an id in order of their components); with
    fewer vectors than entries a codebook has as many entries as there are vectors. Rows without an id are coded but start
    no codebook unless no row has an id. Vectors of unlike lengths are padded with zeros to the longest, rounded up to a
    multiple of `parts`; a component beyond LIMIT / scale counts as that bound. Repeated rows are rows of their own. An empty
    table has no codes and empty codebooks.
    """
    spark = vectors.sparkSession
    rows = written(whole(vectors, scale), "codes-vectors")
    width = rows.agg(F.max(F.size("v"))).first()[0]
    out = "vec_id long, label " + rows.schema["label"].dataType.simpleString() + ", codes array<int>, error long"
    if width is None:
        return spark.createDataFrame([], out), [np.zeros((0, 0), np.int64)] * parts
    width = -(-width // parts) * parts
    books = start(rows, width, parts, entries)
    for _ in range(rounds if width else 0):
        books = step(rows, books, width)

    def code(batches):
        for batch in batches:
            x = _parts(batch.column(2), width, parts)
            codes, error = np.zeros((len(x), parts), np.int32), np.zeros(len(x), np.int64)
            for i in range(0, len(x), ROWS):
                for p, book in enumerate(books):
                    codes[i : i + ROWS, p], far = nearest(x[i : i + ROWS, p], book)
                    error[i : i + ROWS] += far
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, parts), pa.int32()), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, pa.array(error)], names=["vec_id", "label", "codes", "error"])

    return rows.select("vec_id", "label", "v").mapInArrow(code, out), books


def report(vectors: DataFrame, **how) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error, codebooks_sha256, for every kept vector."""
    coded, books = compress(vectors, **how)
    coded = written(coded, "codes")
    # A label's sum is one row a task before it is shuffled; the join on a label that many rows have can be split.
    by_label = coded.groupBy("label").agg(F.try_sum("error").alias("label_error"))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    out = coded.alias("c").join(by_label.alias("l"), F.col("c.label").eqNullSafe(F.col("l.label")), "left")
    return out.select("vec_id", code.alias("code"), "error", "label_error", F.lit(hashlib.sha256(codebooks_text(books).encode()).hexdigest()).alias("codebooks_sha256"))


def _oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> str:
    """The report in DuckDB, for vectors of one length that `parts` divides."""
    sql = [f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor({scale:.0f} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), w AS (SELECT max(len(v)) // {parts} AS d FROM v
), x AS MATERIALIZED (
  SELECT r, (i - 1) // d AS p, (i - 1) % d AS dim, v[i] AS c FROM v, w, unnest(range(1, {parts} * d + 1)) AS t(i)
), b0 AS MATERIALIZED (
  SELECT p, e, dim, c FROM x JOIN (SELECT r, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM v WHERE vec_id IS NOT NULL) USING (r) WHERE e < {entries}
)"""]
    for i in range(rounds + 1):
        sql.append(f"""a{i} AS MATERIALIZED (
  SELECT r, p, arg_min(e, (far, e)) AS e, min(far) AS far
  FROM (SELECT r, x.p, e, sum((x.c - b.c) * (x.c - b.c))::BIGINT AS far FROM x JOIN b{i} b ON b.p = x.p AND b.dim = x.dim GROUP BY ALL) GROUP BY r, p
)""")
        if i < rounds:
            sql.append(f"""b{i + 1} AS MATERIALIZED (
  SELECT b.p, b.e, b.dim, coalesce(n.c, b.c) AS c FROM b{i} b
  LEFT JOIN (SELECT p, e, dim, floor(sum(c)::DOUBLE / count(*))::BIGINT AS c FROM x JOIN a{i} USING (r, p) GROUP BY ALL) n ON n.p = b.p AND n.e = b.e AND n.dim = b.dim
)""")
    return ", ".join(sql) + f""", o AS (
  SELECT vec_id, label, string_agg(lower(printf('%02x', e::INT)), '' ORDER BY p) AS code, sum(far)::BIGINT AS error FROM a{rounds} JOIN v USING (r) GROUP BY r, vec_id, label
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, dim)) FROM b{rounds}) AS codebooks_sha256
FROM o
"""


ORACLE = _oracle()
