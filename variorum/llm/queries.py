"""Thin queries of the training-data operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, language, mixing, pii, sharding, simhash, token_counts, token_files, token_links, toxicity, vector_codes, vector_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES = {
    "op1_histogram_shards": lambda s, d: sharding.shard_documents(_table(s, d, "documents")),
    "op2_simhash_dedup": lambda s, d: simhash.dedup_documents(_table(s, d, "documents")),
    "op3_language_id": lambda s, d: language.identify_documents(_table(s, d, "documents")),
    "op4_find_pii": lambda s, d: pii.pii_documents(_table(s, d, "documents")),
    "op5_bpe_roundtrip": lambda s, d: bpe.tokenize_documents(_table(s, d, "documents")),
    "op6_mix_sources": lambda s, d: mixing.mix_documents(_table(s, d, "documents")),
    "op7_vector_dedup": lambda s, d: vector_dedup.dedup_embeddings(_table(s, d, "embeddings")),
    "op8_learned_partitions": lambda s, d: ann.search_embeddings(_table(s, d, "embeddings")),
    "op9_token_files": lambda s, d: token_files.token_files_of_documents(_table(s, d, "documents")),
    "op10_toxicity": lambda s, d: toxicity.score_documents(_table(s, d, "documents"), _table(s, d, "labels")),
    "op11_vector_codes": lambda s, d: vector_codes.compress_vectors(_table(s, d, "embeddings")),
    "op12_token_links": lambda s, d: token_links.link_documents(_table(s, d, "documents")),
    "op13_token_counts": lambda s, d: token_counts.token_counts_of_documents(_table(s, d, "documents")),
}

ORACLE: dict[str, str] = {"op4_find_pii": pii.oracle(), "op7_vector_dedup": vector_dedup.ORACLE, "op11_vector_codes": vector_codes.oracle()}
