"""History stream: from a topic into the history table."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from moorage.functions.features import parsed_time
from moorage.operators.cleaning import clean, derive
from moorage.operators.daily import MONTH, day_partials, month_of, state_of_days
from moorage.operators.rolling import FRAME
from moorage.settle import settle, settled_for_now
from moorage.sources.topics import parse_history
from moorage.sources.validation import accepted, refused, with_history_reason


def append_history(rows: DataFrame, table: str, batch_id: int, *, partials: str | None = None) -> None:
    """Write one batch of history rows by month, and its partials per key and day; a repeated write replaces itself."""
    month = month_of(parsed_time(F.col("submission_time")))
    rows.withColumn(MONTH, month).write.mode("overwrite").partitionBy(MONTH).parquet(f"{table}/batch_id={batch_id}")
    if partials is not None:
        day_partials(derive(clean(rows))).write.mode("overwrite").parquet(f"{partials}/batch_id={batch_id}")


def current_state(spark: SparkSession, table: str, partials: str, *, complex_templates: Sequence[str] = (), frame: timedelta = FRAME) -> DataFrame:
    """The newest state of all batches stored so far."""
    return state_of_days(spark.read.parquet(partials), spark.read.parquet(table), complex_templates=complex_templates, frame=frame)


def ingest_history(
    messages: DataFrame,
    *,
    table: str,
    dead_letters: str,
    checkpoint: str,
    version: str = "1.1.0",
    repeats_within: str | None = None,
    partials: str | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Append accepted messages to ``table`` (parquet, by month) and put the others aside.

    Each micro-batch has its own sub-folder, so a batch replayed after a failure replaces itself.
    ``partials`` names a folder for the batches' daily statistics, from which the newest state is kept up to date.

    Repeated messages are kept, as a history read from the topic would hold them too, unless ``repeats_within`` names
    a time span: then of accepted messages of one uuid the first is stored, as long as a repeat's timestamp is no
    later than that after it. What is remembered of a uuid is dropped once the watermark has passed it, so the
    state is bounded; a repeat after that is stored again, and one before the watermark is late and left out.
    Refused messages have no part in it: all of them are put aside.
    """
    if repeats_within is not None:
        uuid = F.get_json_object(F.col("value").cast("string"), "$.uuid")
        checked = with_history_reason(messages)
        # A refused message is told apart from all others by its place.
        key = F.when(F.col("reason").isNull(), F.concat(F.lit("u"), uuid)).otherwise(F.concat_ws(" ", F.lit("r"), "partition", "offset"))
        key = F.coalesce(key, F.concat_ws(" ", F.lit("n"), "partition", "offset"))
        watched = checked.withColumn("_told_by", key).withWatermark("timestamp", repeats_within)
        messages = watched.dropDuplicatesWithinWatermark(["_told_by"]).drop("_told_by", "reason")

    def store(batch: DataFrame, batch_id: int) -> None:
        with settled_for_now(batch.sparkSession):
            # The source is read once, for the rows and for the dead letters.
            checked = settle(with_history_reason(batch))
            append_history(parse_history(accepted(checked), version=version), table, batch_id, partials=partials)
            refused(checked).write.mode("overwrite").parquet(f"{dead_letters}/batch_id={batch_id}")

    return (
        messages.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
