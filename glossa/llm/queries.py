"""The registered queries of this subpackage: thin readers around the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm import (centroids, chunk_prints, decontamination, language_id, license_scan, line_dedup, ngram_join, packing,
                        recompression, spelling, suffix_dedup, token_counts, toxicity)
from glossa.llm.oracle import ORACLE
from glossa.session import read_table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = decontamination.contamination(read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        decontamination.is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def op2_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return license_scan.license_scan(read_table(spark, sf, "documents"))


def op3_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "text", "lang")
    held_out = language_id.fold(F.col("doc_id"), 4) == 2
    model = language_id.fit(docs.where(~held_out | F.col("doc_id").isNull()))
    return language_id.identify(docs, model).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_prints.edit_likeness(read_table(spark, sf, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = suffix_dedup.removed_repeats(read_table(spark, sf, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.jaccard_components(read_table(spark, sf, "documents"))


def op7_recompression(spark: SparkSession, sf: str) -> DataFrame:
    found = recompression.deduplicated(read_table(spark, sf, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    held_out = language_id.fold(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs.where(~held_out), read_table(spark, sf, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op9_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf, "documents"), tokenizer_path())


def op10_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf, "documents"), tokenizer_path())


def op11_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.spelling_groups(spelling.word_counts(read_table(spark, sf, "documents"), thin=31))


def op12_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = line_dedup.without_frequent_lines(read_table(spark, sf, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op13_centroid_clustering(spark: SparkSession, sf: str) -> DataFrame:
    return centroids.cluster_report(centroids.fit(read_table(spark, sf, "embeddings")))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_license_scan": op2_license_scan,
    "op3_language_id": op3_language_id,
    "op4_fingerprints": op4_fingerprints,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_ngram_join": op6_ngram_join,
    "op7_recompression": op7_recompression,
    "op8_toxicity": op8_toxicity,
    "op9_packing": op9_packing,
    "op10_token_counts": op10_token_counts,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_line_dedup": op12_line_dedup,
    "op13_centroid_clustering": op13_centroid_clustering,
}
__all__ = ["ORACLE", "QUERIES", "tokenizer_path"]
