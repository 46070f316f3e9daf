"""Request stream: every micro-batch is ranked with the history of its moment."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from moorage.operators.answered import answer_counts, last_cancelled
from moorage.operators.requests import MESSAGE
from moorage.operators.scoring import history_scores
from moorage.plans.inference import RankJob, Scorer, rank_messages
from moorage.schema import AS_SENT
from moorage.settle import settle, settled_for_now, shuffles_removed
from moorage.sources.messages import AnswerSink, write_answers
from moorage.sources.topics import parse_requests
from moorage.sources.validation import accepted, refused, with_request_reason

_ORDER = ["offset", "partition"]


class AnswerLedger:
    """Which past answers still cancel a request.

    Answers are counted once, when a stream first starts; answers given later, also the stream's
    own, do not count.  Every batch notes the cancellations it used, in a folder of its own, and a
    batch looks only at the notes of earlier ones, so that replaying it changes nothing.  At every
    ``summed_every``-th batch what is left is written as a table, from which the batches after it go on.

    Batches are numbered without gaps, so folders are named by number and none is ever listed: a batch costs the same
    however long the stream runs. Notes and sums older than one whole round are deleted, as only the last batch can be replayed.
    """

    def __init__(self, spark: SparkSession, folder: str, *, summed_every: int = 64):
        self.spark, self.folder, self.summed_every = spark, folder.rstrip("/"), summed_every

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        path, files = self._path(name)
        return files.exists(path)

    def freeze(self, answers: DataFrame) -> None:
        """Count the answers, unless an earlier start already did."""
        if not self._exists("answers/_SUCCESS"):
            answer_counts(answers).write.mode("overwrite").parquet(f"{self.folder}/answers")

    def remaining(self, batch_id: int) -> DataFrame:
        """(uuid, answered): answers not used up before batch ``batch_id``."""
        base = batch_id - batch_id % self.summed_every
        if base == batch_id and batch_id and not self._exists(f"left/before={base}/_SUCCESS"):
            self._left(base - self.summed_every, base).write.mode("overwrite").parquet(f"{self.folder}/left/before={base}")
            self._forget(base - self.summed_every)
        return self._left(base, batch_id)

    def _left(self, base: int, batch_id: int) -> DataFrame:
        start = f"left/before={base}" if base else "answers"
        counts = self.spark.read.schema("uuid string, answered bigint").parquet(f"{self.folder}/{start}")
        if base == batch_id:
            return counts
        notes = [f"{self.folder}/used/batch_id={b}" for b in range(base, batch_id)]
        used = self.spark.read.schema("uuid string, used bigint").parquet(*notes).groupBy("uuid").agg(F.sum("used").alias("used"))
        left = F.col("answered") - F.coalesce(F.col("used"), F.lit(0))
        return counts.join(used, "uuid", "left").select("uuid", left.alias("answered")).where("answered > 0")

    def _forget(self, batch_id: int) -> None:
        """Delete the round of notes before a sum, and the sum that they go on from."""
        first = batch_id - self.summed_every
        for name in (f"left/before={first}", *(f"used/batch_id={b}" for b in range(max(0, first), batch_id))):
            path, files = self._path(name)
            files.delete(path, True)

    def note(self, batch_id: int, used: DataFrame) -> None:
        used.write.mode("overwrite").parquet(f"{self.folder}/used/batch_id={batch_id}")


def cancel_answered(requests: DataFrame, remaining: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests still to answer, cancellations used per uuid).

    The cancelled are told by their places alone. Texts are then joined with these by message, in whose order ranking
    wants them, so they move once at most, however many requests are cancelled.
    """
    if MESSAGE not in requests.columns:
        requests = requests.withColumn(MESSAGE, F.struct(*_ORDER))
    cut = settle(last_cancelled(requests, remaining, order=_ORDER))
    gone = requests.select("uuid", MESSAGE).join(cut, "uuid").where(F.col(MESSAGE) <= F.col("cut"))
    still_open = requests.join(settle(gone.select(MESSAGE)), MESSAGE, "left_anti")
    seen = requests.groupBy("uuid").agg(F.count(F.lit(1)).alias("n")).join(remaining, "uuid")
    return still_open, seen.select("uuid", F.least("answered", "n").alias("used"))


def rank_stream(
    messages: DataFrame,
    *,
    answers: DataFrame,
    state: Callable[[SparkSession], DataFrame],
    sink: AnswerSink,
    dead_letters: str,
    ledger: str,
    checkpoint: str,
    job: RankJob = RankJob(),
    scorer: Scorer = history_scores,
    required: Sequence[str] = (),
    trigger: dict | None = None,
) -> StreamingQuery:
    """Rank the requests of a topic-shaped stream.

    ``required`` names candidate fields without which a request is a bad one.

    ``state`` gives the newest history and is asked once per micro-batch.  A bad request goes to
    the dead letters with its reason and the stream goes on.
    """
    book = AnswerLedger(messages.sparkSession, ledger)
    book.freeze(answers)

    def rank(batch: DataFrame, batch_id: int) -> None:
        with settled_for_now(batch.sparkSession), shuffles_removed(batch.sparkSession):
            rank_batch(batch, batch_id)

    def rank_batch(batch: DataFrame, batch_id: int) -> None:
        uuid = F.get_json_object(F.col("value").cast("string"), "$.uuid")
        arrived = settle(with_request_reason(batch, required=required).withColumn("uuid", uuid)).withColumn(MESSAGE, F.struct(*_ORDER))
        # An answer is used up even by a request that could not be answered again.
        still_open, used = cancel_answered(arrived, book.remaining(batch_id))
        book.note(batch_id, used)
        # Read twice from the settled batch, as a second copy of all texts would cost more than a join with the cancelled.
        still_open = still_open.drop("uuid")
        # Brought together by message as texts: candidates, each with its text and typed fields, then stay where they are.
        requests = parse_requests(accepted(still_open).repartition(MESSAGE), version=job.version)
        answered = rank_messages(requests, state(batch.sparkSession), job=job, scorer=scorer, echo=[AS_SENT])
        write_answers(answered, sink, batch=batch_id)
        put_aside = refused(still_open).drop(MESSAGE).write.mode("overwrite").option("compression", "zstd")
        put_aside.parquet(f"{dead_letters}/batch_id={batch_id}")

    return (
        messages.writeStream.foreachBatch(rank)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
