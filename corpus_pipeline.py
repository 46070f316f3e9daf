"""The corpus pipeline: five stages, each an operator applied to all that the stage before kept.

Quality and toxicity models learn from the labels of documents that are still there, outside the folds that
the single queries hold out.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moorage.llm import bbit_minhash, decontaminate, packing, pu_quality, toxic_segments
from moorage.llm.base import documents, prepare_workers, settle, table
from moorage.llm.queries import CONTEXT, QUALITY_CUT, TOXIC_CUT, quality_model, toxic_model
from moorage.llm.tokens import TokenizerFile


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the cut; a null or empty text is scored as empty. Repeated rows stay or go together."""
    prepare_workers(spark)
    score = pu_quality.scorer(spark, quality_model(spark, docs, sf_dir))
    return docs.where(score(F.col("text")) >= QUALITY_CUT)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the cut; a null or empty text is scored as empty and stays where empty texts do.

    Equal texts score alike, and repeated rows stay or go together.
    """
    prepare_workers(spark)
    score = toxic_segments.scorer(spark, toxic_model(spark, docs, sf_dir))
    return docs.where(score(F.col("text")) < TOXIC_CUT)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more.

    It is the one with the least id; of rows that repeat it, one. Texts without words, null ones too, are near nothing, so one
    row of each id stays.
    """
    prepare_workers(spark)
    return bbit_minhash.first_of_each(docs, bbit_minhash.MinHashSpec())


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none. Repeated rows stay or go together."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place; a null or empty text is a piece with the end id alone.

    Every row of a repeated document is packed.
    """
    prepare_workers(spark)
    tokenizer = TokenizerFile.read(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack_documents(docs, tokenizer, capacity=CONTEXT, end_id=0)


STAGES = [
    ("pu_quality", good_quality),
    ("toxic_segments", not_toxic),
    ("bbit_minhash", one_of_each),
    ("benchmark_search", without_benchmark),
    ("best_fit_packing", packed),
]

#: SQL can't express the stages; they are tested against brute force on a small fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
