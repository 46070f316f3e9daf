"""Small inputs that every operator must take: nulls, empties, repeated rows, long texts, clashing columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{i % 977} Other{i % 31}," for i in range(20_000))


def odd_rows() -> list[tuple]:
    text = "The quick brown fox jumps over the lazy dog, and then it does so again while nobody looks at all."
    return [
        (1, text, "en", "a", 5),
        (1, text, "en", "a", 5),
        (2, text, "en", None, None),
        (3, None, "en", "a", None),
        (4, "", None, "a", 0),
        (5, " \n\t ", None, None, 4),
        (None, text + " More.", "en", "b", 3),
        (None, None, None, None, None),
        (6, "été œuvre 中文 😀 <|endoftext|> ß", "fr", "b", 9),
        (7, LONG, "en", "a", len(LONG)),
        (8, "x" * 5000, "en", "a", 5000),
    ]


def odd_documents(spark: SparkSession) -> DataFrame:
    """With further columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(odd_rows(), SCHEMA)
    names = ["score", "kept", "digest", "bucket", "chunk", "shard", "lang_pred", "group", "sequence_id", "component", "node", "held_out_", "n_tokens"]
    return rows.withColumns({n: F.lit("clash") for n in names})


def no_documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
