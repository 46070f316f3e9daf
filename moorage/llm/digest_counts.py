"""Token counts through a digest cache."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moorage.llm.base import map_rows, settle
from moorage.llm.tokens import TokenizerFile, encoder

CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens bigint"


def count_tokens(docs: DataFrame, tokenizer: TokenizerFile, cache_path: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens; new counts are appended to the cache.

    The cache is a Parquet table of (content digest, tokenizer digest, count). Every content is looked up by
    both digests; of the missing contents one row each is encoded, whole, and appended; then all rows take
    their counts from the cache. Content is normalised only where that cannot change a count: runs of ASCII
    white space become one space, and none at the ends, for tokenizers that drop white space.

    Only digests meet per content, combined before their shuffle, so a text with many copies is no hot key;
    texts move once, by (digest, id). Null text counts as empty; rows with equal or null ids each get their
    row; an empty table gives an empty result. Other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    shown = F.coalesce(F.col(text), F.lit(""))
    content = F.trim(F.regexp_replace(shown, r"[ \t\n\x0B\f\r]+", " ")) if tokenizer.drops_space else shown
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), shown.alias("text"), F.unhex(F.sha2(content, 256)).alias("content_digest"))
    digests = settle(texts.select("doc_id", "content_digest", F.octet_length("text").cast("bigint").alias("n_bytes")))

    # A null id takes the place of -1 here: rows of one content are all as good to encode.
    key = F.coalesce("doc_id", F.lit(-1))
    missing = digests.groupBy("content_digest").agg(F.min(key).alias("first_id"))
    stored = stored_counts(spark, cache_path, tokenizer)
    if stored is not None:
        missing = missing.join(stored, "content_digest", "left_anti")
    wanted = texts.withColumn("first_id", key).join(missing, ["content_digest", "first_id"], "left_semi").dropDuplicates(["content_digest", "first_id"])
    encode(wanted.select("content_digest", "text"), tokenizer).write.mode("append").parquet(cache_path)

    # Settled, so that both sides of the join are plain exchanges and a content with many rows may be split.
    counts = settle(stored_counts(spark, cache_path, tokenizer))
    return digests.join(counts, "content_digest", "left").select("doc_id", "n_bytes", "n_tokens")


def stored_counts(spark, cache_path: str, tokenizer: TokenizerFile) -> DataFrame | None:
    """The tokenizer's counts in the cache, one per content; None where there is no cache yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer_digest") == tokenizer.digest)
    return stored.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))


def encode(wanted: DataFrame, tokenizer: TokenizerFile) -> DataFrame:
    sent, digest = wanted.sparkSession.sparkContext.broadcast(tokenizer.text), tokenizer.digest

    def rows(batches):
        ids = encoder(sent.value).ids
        for batch in batches:
            counts = [len(ids(t)) // 4 for t in batch["text"]]
            yield {"content_digest": batch["content_digest"], "tokenizer_digest": [digest] * len(counts), "n_tokens": counts}

    return map_rows(wanted, rows, CACHE_SCHEMA)
