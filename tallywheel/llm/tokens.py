"""Exact token counts: documents aggregated by encoded length.

The histogram of lengths is exact and small (a row for each length that occurs). Suffix sums over it answer every
question of the kind: how many tokens in all, how many documents are longer than a limit, what is lost if each is
cut at a limit, which length is a quantile.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallywheel.llm._common import written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MOST_VOCABULARY_MB = 64
#: Fixed value: the published pattern that splits text before byte-level BPE of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 512

_encoders: dict = {}


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read((MOST_VOCABULARY_MB << 20) + 1)
    if len(data) > MOST_VOCABULARY_MB << 20:
        raise ValueError(f"the vocabulary {path} is larger than {MOST_VOCABULARY_MB} MB; it is sent to every executor")
    return data


def encoder(vocabulary: bytes, pattern: str = PATTERN):
    """A tiktoken encoding from the bytes of a rank file; made once a process."""
    key = (hashlib.sha256(vocabulary).digest(), pattern)
    if key not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        _encoders[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def histogram(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, text_col: str = "text") -> DataFrame:
    """(n_tokens, n_docs): how many rows of docs have each encoded length. Null and empty texts have length 0.

    The vocabulary file is read on the driver and broadcast (its size is checked); executors need no such file. Each
    batch of texts leaves Python as its own small histogram. An empty table has an empty histogram.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches):
        encode = encoder(shared.value, pattern).encode_ordinary
        for batch in batches:
            counts: dict[int, int] = {}
            for text in batch.column(0).to_pylist():
                n = len(encode(text)) if text else 0
                counts[n] = counts.get(n, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.int64()), pa.array(counts.values(), pa.int64())], names=["n_tokens", "n"])

    parts = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "n_tokens long, n long")
    return parts.groupBy("n_tokens").agg(F.sum("n").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """hist with docs_at_least and tokens_at_least (rows of this length and longer), docs_up_to, and kept_tokens (all tokens if
    every document is cut at this length).

    Sums run over blocks of lengths first and within a block then, so that no task holds the whole histogram.
    """
    rows = hist.withColumns({"tokens": F.col("n_tokens") * F.col("n_docs"), "block": F.floor(F.col("n_tokens") / BLOCK)})
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    later = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    beyond = blocks.select("block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("later_docs"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("later_tokens"), F.sum("d").over(whole).alias("all_docs"), F.sum("t").over(whole).alias("all_tokens"))
    inside = W.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, 0)
    out = rows.join(beyond, "block").withColumns({
        "docs_at_least": F.sum("n_docs").over(inside) + F.col("later_docs"),
        "tokens_at_least": F.sum("tokens").over(inside) + F.col("later_tokens"),
    })
    kept = F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")
    up_to = F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")
    return out.select("n_tokens", "n_docs", "tokens", "docs_at_least", "tokens_at_least", up_to.alias("docs_up_to"), kept.alias("kept_tokens"))


def length_table(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """The histogram of docs with its suffix sums; texts are encoded once."""
    return suffix_sums(written(histogram(docs, vocabulary, pattern), "token-lengths"))


def at_limits(lengths: DataFrame, limits: Sequence[int]) -> DataFrame:
    """(context_limit, n_docs, total_tokens, docs_truncated, kept_tokens) from a length table, for each limit."""
    rows = lengths.withColumn("context_limit", F.explode(F.array(*(F.lit(int(x)).cast("long") for x in limits))))
    over = F.col("n_tokens") > F.col("context_limit")
    return rows.groupBy("context_limit").agg(
        F.sum("n_docs").alias("n_docs"),
        F.sum("tokens").alias("total_tokens"),
        F.sum(F.when(over, F.col("n_docs")).otherwise(0)).alias("docs_truncated"),
        F.sum(F.least("n_tokens", "context_limit") * F.col("n_docs")).alias("kept_tokens"),
    )


def quantiles(lengths: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(share, n_tokens): the smallest length that at least this share of the documents don't exceed."""
    rows = lengths.withColumn("share", F.explode(F.array(*(F.lit(float(x)) for x in shares))))
    total = lengths.agg(F.max("docs_up_to")).first()[0] or 0
    return rows.filter(F.col("docs_up_to") >= F.ceil(F.col("share") * F.lit(total))).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
