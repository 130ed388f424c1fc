"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Every document of a source has the same expected number of copies, target / source size. Documents stand in a line
(by size class, then by a hash of the id, so that a prefix of the line has every size in proportion); the prefix sum
of expected copies plus one random offset a source emits a document once for each integer boundary it crosses.

The prefix sum never gathers a source in one task: the line is cut into cells (source, size class, salt), whose
counts are summed first; within a cell a row number completes the sum. The number of salts follows the number of
rows, so that a source, or a group of equal copies, that holds a third of all rows is spread over many cells; so is a
row that is repeated as often.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallywheel.llm._common import WORD, as_row, written

ROWS_PER_SALT, MOST_SALTS = 4096, 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    """Four classes an octave: sizes of a class differ by less than a quarter."""
    bits = F.length(F.bin(size))
    quarter = F.floor(size / F.pow(F.lit(2.0), bits - 3)).cast("long") % 4
    return F.when(size < 4, size).otherwise(bits * 4 + quarter).cast("int")


def hash32(text: Column) -> Column:
    """The first 32 bits of the MD5 of a text, as a long."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(key, source, source_size) -> the same with target: share of all sizes dealt by weight, at most `most` times a size.

    Sources take the weights in turn by code point, null last. Pouring by weight until each source is at its limit is
    water-filling: target = min(limit, level * weight), and the level is the largest of the levels that the sources in
    order of limit / weight would give. The table has a row for each source.
    """
    everything, by_name = W.partitionBy(), W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("w", w).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    by_limit = W.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("limit").over(by_limit.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("w").over(by_limit.rowsBetween(0, W.unboundedFollowing))
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    rows = rows.withColumn("before", before).withColumn("after", after)
    rows = rows.withColumn("level", F.max((total - F.col("before")) / F.col("after")).over(everything))
    return rows.select("key", "source", "source_size", F.least("limit", F.col("level") * F.col("w")).alias("target"))


def with_copies(rows: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """rows (source, id, text_hash, size, line and whatever they carry) with source_size, target and copies.

    line names a row's place; rows of one line that are more than a cell should hold are alike (they repeat an id, or a
    text without an id), so that they may stand in any order: they are dealt to cells of their own by chance.
    """
    n = rows.count()
    salts = int(max(1, min(MOST_SALTS, -(-n // ROWS_PER_SALT))))
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    rows = rows.withColumns({"key": key, "class": size_class(F.col("size")), "salt": (hash32(F.col("line")) % salts).cast("int"), "sub": F.lit(0)})
    cell = ["key", "class", "salt", "sub"]
    counted = lambda rows: written(rows.groupBy(*cell).agg(F.first("source").alias("source"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")), "mix-cells")
    cells = counted(rows)
    full = cells.filter(F.col("n") > 4 * max(ROWS_PER_SALT, n // MOST_SALTS)).select(*cell)
    if full.limit(1).count():
        many = rows.join(full, cell, "left_semi").groupBy("line", "text_hash").agg(F.count(F.lit(1)).alias("of")).filter(F.col("of") > ROWS_PER_SALT)
        many = written(many.select(F.col("line").alias("many_line"), F.col("text_hash").alias("many_hash"), F.ceil(F.col("of") / ROWS_PER_SALT).alias("subs")), "mix-many")
        dealt = rows.join(many, (F.col("line") == F.col("many_line")) & F.col("text_hash").eqNullSafe(F.col("many_hash")), "left")
        # By chance, so the draw is written once: both the counts and the ranks see the same.
        rows = written(dealt.withColumn("sub", F.coalesce(1 + F.floor(F.rand(seed) * F.col("subs")), F.lit(0)).cast("int")).drop("many_line", "many_hash", "subs"), "mix-dealt")
        cells = counted(rows)
    sizes = cells.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    want = targets(sizes, weights, share, most).select("key", "source_size", "target")
    start = F.sum("n").over(W.partitionBy("key").orderBy("class", "salt", "sub")) - F.col("n")
    placed = cells.select(*cell, start.alias("start")).join(want, "key")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = hash32(F.concat(F.lit(f"{seed}|"), F.col("key"))) / F.lit(4294967296.0)
    rank = F.row_number().over(W.partitionBy(*cell).orderBy("size", "id", "text_hash")) + F.col("start")
    # Sort-merge, on the exchange that the row number needs anyway; the cells grow with the input and aren't for broadcast.
    out = rows.join(placed.hint("merge"), cell).withColumns({"rank": rank, "rate": rate, "offset": offset})
    crossed = F.floor(F.col("offset") + F.col("rate") * F.col("rank")) - F.floor(F.col("offset") + F.col("rate") * (F.col("rank") - 1))
    return out.withColumn("copies", crossed.cast("int")).drop(*cell, "start", "rank", "rate", "offset")


def placed_rows(docs: DataFrame, *carried: Column) -> DataFrame:
    """What with_copies() needs of documents. line: the id, or the text's MD5 where there is none, so that rows without one spread."""
    id = F.col("doc_id").cast("long")
    line = F.coalesce(id.cast("string"), F.md5(F.col("text").cast("binary")), F.lit(""))
    return docs.select(*carried, "source", id.alias("id"), F.xxhash64("text").alias("text_hash"), word_count(F.col("text")).alias("size"), line.alias("line"))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """The columns of docs; each row as many times as the mix takes it (none, once, or up to ceil(most) times).

    Null or wordless texts have size 0 and the same expected copies as their source. A null source is a source of its
    own; rows without an id, repeated rows and ties are dealt like any other. Long texts count all their words. Columns
    of any name are carried as they are. An empty table gives an empty mix.
    """
    rows = with_copies(placed_rows(docs, as_row(docs)), weights, share, most, seed)
    return rows.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("row.*")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes of the document, repeats counted)."""
    rows = with_copies(written(placed_rows(docs), "mix-sizes"), **options)
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


#: The query's rows in DuckDB: seed 7, weights 3, 1, 2, share 1.5, limit 2.
ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(doc_id::VARCHAR, md5(text), '') AS line, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), salts AS (SELECT greatest(1, least(4096, ceil(count(*) / 4096)))::BIGINT AS salts FROM sized),
keyed AS (
  SELECT *, coalesce('s' || source, 'n') AS k,
         CASE WHEN size < 4 THEN size ELSE length(bin(size)) * 4 + (size >> (length(bin(size)) - 3)) % 4 END AS class,
         (('0x' || substr(md5(line), 1, 8))::BIGINT) % salts AS salt
  FROM sized, salts
), sources AS (SELECT k, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY k),
weighted AS (
  SELECT *, ([3.0, 1.0, 2.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap
  FROM sources
), poured AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before,
         sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after,
         (sum(source_size) OVER () * 1.5::DOUBLE)::DOUBLE AS total
  FROM weighted
), want AS (
  SELECT k, source_size, least(cap, max((total - before) / after) OVER () * w)::DOUBLE AS target,
         (('0x' || substr(md5('7|' || k), 1, 8))::BIGINT) / 4294967296.0::DOUBLE AS u
  FROM poured
), ranked AS (
  SELECT keyed.doc_id, keyed.size, want.*, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS r,
         row_number() OVER (PARTITION BY keyed.k ORDER BY class, salt, size, doc_id NULLS FIRST) AS n
  FROM keyed JOIN want ON keyed.k = want.k
)
SELECT doc_id, size, source_size, target, ((floor(u + r * n) - floor(u + r * (n - 1))) * size)::BIGINT AS taken FROM ranked
"""
