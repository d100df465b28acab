"""One query for each operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlens.llm import (
    chat, decontamination, fingerprints, language, language_model, manifest, mixing, reputation, sharding, simhash, token_counts, toxicity, trie,
)
from rosterlens.llm.oracle import ORACLE as ORACLE
from rosterlens.llm.text import fold, table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from three quarters of the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = toxicity.train(docs.where(~held_out), table(spark, sf_dir, "labels").where(~held_out))
    scored = toxicity.with_score(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likeness."""
    found = fingerprints.edited_copies(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", fingerprints.as_text(F.col("codes")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_codes")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("codes"), F.col("edited_codes")).alias("near_edited"),
        fingerprints.likeness(F.col("codes"), F.col("next_codes")).alias("near_next"),
    )


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from three quarters of them."""
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = language.train(docs.where(~held_out))
    found = language.with_language(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", F.col("found.language").alias("lang_pred"), "found.score", "found.rejected")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page."""
    return reputation.judged(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    planned = mixing.plan(table(spark, sf_dir, "documents"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations, rendered."""
    found = chat.format_chats(table(spark, sf_dir, "conversations"))
    return found.withColumn("n_turns", F.col("n_turns").cast("long"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document, test item) pairs where the document contains the item."""
    found = decontamination.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    counts = [F.col(c).cast("long").alias(c) for c in ("n_shingles", "n_found")]
    return found.select("doc_id", "item_id", *counts, F.round("containment", 6).alias("containment"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document by counts and by the recurrent model."""
    docs = table(spark, sf_dir, "documents")
    found = language_model.scored(docs, fold(F.col("doc_id"), 7) != 2)
    return found.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    import public_tokenizers

    return token_counts.measured(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, equal texts together."""
    found = sharding.placed(table(spark, sf_dir, "documents"))
    return found.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether a tampered row is found out."""
    return manifest.verified(table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations."""
    return trie.conversation_trie(table(spark, sf_dir, "conversations"))


TOKENIZER = "byte_bpe_50k.json"

QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_document_fingerprints": op3_document_fingerprints,
    "op4_language_id": op4_language_id,
    "op5_url_filters": op5_url_filters,
    "op6_source_mixing": op6_source_mixing,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_token_counts": op10_token_counts,
    "op11_sharding": op11_sharding,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_conversation_trie": op13_conversation_trie,
}
