"""The registered queries of this package."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moorage.llm import adaptive_rules, bbit_minhash, context_tree, decontaminate, digest_counts, importance_resampling, language_mix, packing, pu_quality, quotient_filters, repair, rotated_centroids, toxic_segments
from moorage.llm.base import documents, fold, fresh_folder, table
from moorage.llm.tokens import TokenizerFile

Query = Callable[[SparkSession, str], DataFrame]

#: Tokens a document may have before it counts as long, and tokens of a packed sequence.
CONTEXT = 2048
#: Scores from which a text counts as good, and as toxic.
QUALITY_CUT, TOXIC_CUT = 0.7, 0.5


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> pu_quality.PuModel:
    """Trusted positives are rows labelled 1 outside the held-out fold; everything else is unlabelled."""
    positives = table(spark, sf_dir, "labels").where((F.col("quality") == 1) & (fold(F.col("doc_id"), 4) != 2))
    return pu_quality.train(docs, positives.select("doc_id"))


def op1_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = pu_quality.score(docs, quality_model(spark, docs, sf_dir))
    held_out = (fold(F.col("doc_id"), 4) == 2).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"))


def toxic_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxic_segments.ToxicModel:
    """Labels outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0)
    return toxic_segments.train(docs, labels.select("doc_id", "toxic"))


def op3_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = toxic_segments.score(docs, toxic_model(spark, docs, sf_dir))
    held_out = (fold(F.col("doc_id"), 5) == 0).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= TOXIC_CUT).cast("int").alias("predicted"))


def op4_language_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 3) == 1
    model = language_mix.train(docs.where(~held_out))
    return language_mix.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = TokenizerFile.read(public_tokenizers.path("word_bpe_49k.json"))
    counts = digest_counts.count_tokens(documents(spark, sf_dir), tokenizer, fresh_folder(spark, "token-counts"))
    return counts.withColumn("over_limit", F.col("n_tokens") > CONTEXT)


def op5_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptive_rules.quality_rules(documents(spark, sf_dir))


def op6_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = bbit_minhash.MinHashSpec(words=3, numerator=85, denominator=100)
    return bbit_minhash.near_duplicates(documents(spark, sf_dir), spec).drop("text_hash")


def op7_benchmark_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op8_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", (fold(F.col("doc_id"), 7) == 2).alias("held_out"))
    return context_tree.score_documents(docs)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = TokenizerFile.read(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack_documents(documents(spark, sf_dir), tokenizer, capacity=CONTEXT, end_id=0)


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = TokenizerFile.read(public_tokenizers.path("word_bpe_49k.json"))
    path = fresh_folder(spark, "token-ids")
    repair.write_ids(documents(spark, sf_dir), tokenizer, path, end_id=1)
    return repair.read_ids(spark, path)


def op11_rotated_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotated_centroids.cluster(table(spark, sf_dir, "embeddings")).drop("centroid")


def op12_quotient_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotient_filters.exact_duplicates(documents(spark, sf_dir))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.resample(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    "op1_pu_quality": op1_pu_quality,
    "op3_toxic_segments": op3_toxic_segments,
    "op4_language_mix": op4_language_mix,
    "op2_token_counts": op2_token_counts,
    "op5_adaptive_rules": op5_adaptive_rules,
    "op6_bbit_minhash": op6_bbit_minhash,
    "op7_benchmark_search": op7_benchmark_search,
    "op8_context_tree": op8_context_tree,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_token_ids": op10_token_ids,
    "op11_rotated_centroids": op11_rotated_centroids,
    "op12_quotient_filters": op12_quotient_filters,
    "op13_importance_resampling": op13_importance_resampling,
}
