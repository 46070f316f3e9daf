"""Request and answer messages: reading, and writing the ranking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moorage.schema import CANDIDATE_FIELDS
from moorage.sources.jsonfiles import holds_documents, json_reader
from moorage.sources.topics import Topic, answer_messages, parse_requests, request_texts
from moorage.sources.validation import NO_PROVIDERS, raise_refusals, refusals, with_request_reason


def request_messages(spark: SparkSession, path: str) -> DataFrame:
    """The requests of a JSON array or of JSON lines as messages: ``msg_id`` (place) and ``value`` (text).

    They go through the same checks and the same parser as those of a topic.
    """
    if path is None:
        raise ValueError("no request file is set")
    if not holds_documents(spark, path):
        lines = spark.read.text(path).where(F.trim("value") != "")
        return lines.select(F.monotonically_increasing_id().alias("msg_id"), "value")
    texts = spark.read.text(path, wholetext=True).where(F.trim("value") != "")
    one = F.array(F.col("value"))
    several = F.from_json(F.col("value"), "array<string>")
    rows = texts.select(F.explode(F.when(F.ltrim("value").startswith("{"), one).otherwise(several)).alias("value"))
    return rows.withColumn("msg_id", F.monotonically_increasing_id()).select("msg_id", "value")


def read_requests(spark: SparkSession, path: str, *, version: str = "1.1.0") -> DataFrame:
    """Requests from a JSON array or JSON lines, numbered by their place (``msg_id``).

    One refused request fails the read, as one of a version or with fields that are not known would be
    answered wrongly. Those without candidates stay, for ``route`` to tell apart.
    """
    checked = with_request_reason(request_messages(spark, path), required=CANDIDATE_FIELDS)
    raise_refusals(checked.where(F.coalesce(F.col("reason") != NO_PROVIDERS, F.lit(False))).agg(*refusals()).first())
    return parse_requests(checked.drop("reason"), version=version)


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """The uuids of a JSON file or folder of answers: arrays, or lines as ``write_answers`` makes them."""
    return json_reader(spark, path).schema("uuid string").json(path)


@dataclass(frozen=True)
class MessageSource:
    """Where requests or answers come from: a JSON file or folder, or a topic."""

    path: str | None = None
    topic: Topic | None = None

    def __post_init__(self):
        if (self.path is None) == (self.topic is None):
            raise ValueError("give either a path or a topic")


def open_sources(spark: SparkSession, requests: MessageSource, answers: MessageSource) -> tuple[DataFrame, DataFrame]:
    """(request messages, uuids of past answers), each from a file or a topic.

    Requests of a topic that waits for messages are a stream, any others a table; both have the text in ``value``.
    Answers are always a table, as they are counted once at the start.
    """
    if requests.path is not None:
        asked = request_messages(spark, requests.path)
    else:
        asked = requests.topic.read_stream(spark) if requests.topic.timeout_ms == 0 else requests.topic.read(spark)
    if answers.path is not None:
        return asked, read_answers(spark, answers.path)
    return asked, answer_uuids(answers.topic.read(spark))


def answer_uuids(messages: DataFrame) -> DataFrame:
    """The uuids of answer messages; a message without one cancels nothing."""
    uuid = F.get_json_object(F.col("value").cast("string"), "$.uuid")
    return messages.select(uuid.alias("uuid")).where("uuid IS NOT NULL")


@dataclass(frozen=True)
class AnswerSink:
    """Either a folder of JSON lines or a topic; ``compression`` is that of the lines' files, by which readers tell it."""

    path: str | None = None
    topic: Topic | None = None
    compression: str = "gzip"

    def __post_init__(self):
        if (self.path is None) == (self.topic is None):
            raise ValueError("give either a path or a topic")


def write_answers(answers: DataFrame, sink: AnswerSink, *, batch: int | None = None) -> None:
    """Emit ``(uuid, ranked_providers)`` rows.

    To a folder they are appended; a numbered stream batch has its own sub-folder, which a replay
    overwrites.  A topic receives a replayed batch again.
    """
    messages = answer_messages(answers)
    if sink.topic is not None:
        sink.topic.write(messages)
    elif batch is None:
        messages.write.mode("append").option("compression", sink.compression).text(sink.path)
    else:
        messages.write.mode("overwrite").option("compression", sink.compression).text(f"{sink.path}/batch_id={batch}")


def publish_requests(requests: DataFrame, topic: Topic) -> None:
    """Send all requests to their topic."""
    topic.write(request_texts(requests))
