"""The registered queries of this package and their SQL. Every query reads its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywheel.llm import decontam, mixing, quality, secrets, sharding, simhash, suffixes, tokens, topk, toxicity, trie, vectorcodes, warc
from tallywheel.llm._common import table


def op1_mixing_systematic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents at 150%: doc_id, size, source_size, target, taken."""
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op2_quality_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of all documents: doc_id, held_out, score, predicted."""
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_warc_gzip_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through WARC archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url")


def op4_token_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact histogram of encoded lengths of all documents, with its suffix sums."""
    return tokens.length_table(table(spark, sf_dir, "documents"))


def op5_secret_random_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate secret of all documents: doc_id, position, n_chars, digest, score, is_secret."""
    return secrets.scan(table(spark, sf_dir, "documents"))


def op6_sharding_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of equal counts: doc_id, size, text_crc32, law, shard, slot, grown_shard, cut_links."""
    return sharding.shard_report(table(spark, sf_dir, "documents"))


def op7_topk_dual_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best by inner product for every 50th vector: query_id, rank, vec_id, score."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op8_toxicity_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of all documents: doc_id, held_out, score, predicted."""
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_decontamination_cgk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds: doc_id, item_id, edits, first_word."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash groups of all documents: doc_id, fingerprint, component_id."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op11_partial_distance_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes of all vectors: vec_id, code, error, label_error, codebooks_sha256."""
    return vectorcodes.report(table(spark, sf_dir, "embeddings"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of all conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_suffix_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without passages of 400 bytes that repeat: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return suffixes.report(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_mixing_systematic": op1_mixing_systematic,
    "op2_quality_bradley_terry": op2_quality_bradley_terry,
    "op3_warc_gzip_normaliser": op3_warc_gzip_normaliser,
    "op4_token_length_histogram": op4_token_length_histogram,
    "op5_secret_random_forest": op5_secret_random_forest,
    "op6_sharding_label_propagation": op6_sharding_label_propagation,
    "op7_topk_dual_cover_tree": op7_topk_dual_cover_tree,
    "op8_toxicity_string_kernel": op8_toxicity_string_kernel,
    "op9_decontamination_cgk": op9_decontamination_cgk,
    "op10_simhash_golay": op10_simhash_golay,
    "op11_partial_distance_codes": op11_partial_distance_codes,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_suffix_run_index": op13_suffix_run_index,
}

ORACLE_SQL: dict[str, str] = {
    "op1_mixing_systematic": mixing.ORACLE,
    "op3_warc_gzip_normaliser": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest, max(page_id) OVER (PARTITION BY h) AS last FROM p),
r AS (SELECT *, payload_bytes >= 1000 AND page_id IS DISTINCT FROM last AND last IS NOT NULL AS again FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN last END AS refers_to
FROM r
""",
    "op7_topk_dual_cover_tree": topk.ORACLE,
    "op11_partial_distance_codes": vectorcodes.ORACLE,
    "op12_conversation_trie": trie.ORACLE,
}
