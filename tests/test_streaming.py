import json
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from moorage.operators.cleaning import clean, derive
from moorage.operators.latest import latest_state
from moorage.plans.inference import history_state
from moorage.schema import TOPIC_SCHEMA
from moorage.settle import settle, shared_folder
from moorage.sources.history import read_history_files
from moorage.sources.messages import AnswerSink, write_answers
from moorage.streaming import ranking
from moorage.streaming.ingest import append_history, current_state, ingest_history
from moorage.streaming.ranking import AnswerLedger, rank_stream
from tests.test_ranking import candidate


@pytest.fixture
def folder(spark):
    return f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"


def send(spark, folder, start, *messages):
    rows = [
        (None, m if isinstance(m, str) else json.dumps(m), "t", 0, start + i, None) for i, m in enumerate(messages)
    ]
    spark.createDataFrame(rows, TOPIC_SCHEMA).coalesce(1).write.mode("append").json(f"{folder}/topic")


def stream(spark, folder):
    return spark.readStream.schema(TOPIC_SCHEMA).json(f"{folder}/topic")


def request(name, *providers, version="1.1.0"):
    return {"uuid": name, "msg_version": version, "template_name": "tpl1", "providers": list(providers)}


def test_history_ingestion(spark, folder, history_row):
    def run():
        ingest_history(
            stream(spark, folder),
            table=f"{folder}/history.parquet",
            dead_letters=f"{folder}/refused",
            checkpoint=f"{folder}/checkpoint",
        ).awaitTermination()

    send(spark, folder, 0, {"msg_version": "1.1.0", **history_row}, {"msg_version": "0", **history_row})
    run()
    send(spark, folder, 2, {"msg_version": "1.1.0", **history_row, "submission_time": "2024-02-01"})
    run()
    table = read_history_files(spark, f"{folder}/history.parquet")
    assert clean(table).count() == 2
    refused = spark.read.parquet(f"{folder}/refused").collect()
    assert [r["reason"] for r in refused] == ["unsupported version: 0"]


def test_request_stream_with_restart(spark, folder, make_history):
    history = make_history(
        {"provider_name": "good", "region_name": "r"},
        {"provider_name": "bad", "region_name": "r", "status": "CREATE_FAILED"},
    )
    state = history_state(history)
    past = spark.createDataFrame([("a",), ("a",), ("c",), ("none",)], "uuid string")

    def run(answers):
        rank_stream(
            stream(spark, folder),
            answers=answers,
            state=lambda _: state,
            sink=AnswerSink(path=f"{folder}/answers"),
            dead_letters=f"{folder}/refused",
            ledger=f"{folder}/ledger",
            checkpoint=f"{folder}/checkpoint",
        ).awaitTermination()

    def answered():
        rows = spark.read.schema("uuid string, ranked_providers array<struct<provider_name string>>").json(
            f"{folder}/answers"
        )
        return sorted((r["uuid"], [p["provider_name"] for p in r["ranked_providers"]]) for r in rows.collect())

    two = [candidate("bad"), candidate("good")]
    send(
        spark,
        folder,
        0,
        request("a", *two),
        request("b", *two),
        request("b", *two),
        request("d", *two, version="7"),
        request("none"),
        request("nobody"),
        "no json",
    )
    run(past)
    ranking = ["good", "bad"]
    assert answered() == [("b", ranking), ("b", ranking)]
    reasons = sorted(r["reason"] for r in spark.read.parquet(f"{folder}/refused").collect())
    assert reasons == ["no providers", "not a JSON object", "unsupported version: 7"]

    # After a restart one answer of 'a' is left; the new answers given here do not count.
    send(spark, folder, 7, request("a", *two), request("a", *two), request("c", *two), request("b", candidate("x")))
    run(spark.createDataFrame([("b",)], "uuid string"))
    assert answered() == [("a", ranking), ("b", ranking), ("b", ranking), ("b", ["x"])]


def test_ledger_ignores_the_batch_itself_and_later_ones(spark, folder):
    book = AnswerLedger(spark, folder)
    book.freeze(spark.createDataFrame([("a",)] * 3 + [("b",)], "uuid string"))
    book.freeze(spark.createDataFrame([("z",)], "uuid string"))

    def left(batch):
        return {r["uuid"]: r["answered"] for r in book.remaining(batch).collect()}

    used = "uuid string, used bigint"
    assert left(0) == {"a": 3, "b": 1}
    book.note(0, spark.createDataFrame([("a", 2)], used))
    book.note(1, spark.createDataFrame([("b", 1)], used))
    assert left(0) == {"a": 3, "b": 1} and left(1) == {"a": 1, "b": 1} and left(2) == {"a": 1}
    book.note(0, spark.createDataFrame([("a", 1)], used))
    assert left(1) == {"a": 2, "b": 1}


def test_history_is_refreshed_for_every_batch(spark, folder, make_history):
    """Two micro-batches between which the better provider changes; nothing that they settle stays."""
    better = iter(["good", "bad"])

    def state(_):
        first = next(better)
        second = "bad" if first == "good" else "good"
        return history_state(
            make_history(
                {"provider_name": first, "region_name": "r"},
                {"provider_name": second, "region_name": "r", "status": "CREATE_FAILED"},
            )
        )

    two = [candidate("bad"), candidate("good")]
    send(spark, folder, 0, request("a", *two))
    send(spark, folder, 1, request("b", *two))

    def settled():
        return {n for n in os.listdir(shared_folder(spark).removeprefix("file:")) if n.startswith("settled-")}

    before = settled()
    rank_stream(
        spark.readStream.schema(TOPIC_SCHEMA).option("maxFilesPerTrigger", 1).json(f"{folder}/topic"),
        answers=spark.createDataFrame([], "uuid string"),
        state=state,
        sink=AnswerSink(path=f"{folder}/answers"),
        dead_letters=f"{folder}/refused",
        ledger=f"{folder}/ledger",
        checkpoint=f"{folder}/checkpoint",
    ).awaitTermination()
    rows = spark.read.schema("uuid string, ranked_providers array<struct<provider_name string>>").json(f"{folder}/answers")
    orders = [[p["provider_name"] for p in r["ranked_providers"]] for r in rows.orderBy("batch_id").collect()]
    assert orders == [["good", "bad"], ["bad", "good"]]
    assert settled() == before


def test_summed_ledger_equals_all_notes(spark, folder):
    plain, summed = AnswerLedger(spark, f"{folder}/a", summed_every=1000), AnswerLedger(spark, f"{folder}/b", summed_every=2)
    answers = spark.createDataFrame([(f"u{i % 5}",) for i in range(40)], "uuid string")

    def left(book, batch):
        return sorted(map(tuple, book.remaining(batch).collect()))

    for book in (plain, summed):
        book.freeze(answers)
    for batch in range(9):
        assert left(plain, batch) == left(summed, batch) == left(summed, batch)
        for book in (plain, summed):
            book.note(batch, spark.createDataFrame([(f"u{batch % 5}", 2), ("u1", 1)], "uuid string, used bigint"))
        # The last batch may be replayed.
        assert left(plain, batch) == left(summed, batch)
    at = f"{folder}/b".removeprefix("file:")
    assert len(os.listdir(f"{at}/used")) <= 2 * 2 + 1 and len(os.listdir(f"{at}/left")) <= 2


def test_a_late_batch_reads_no_more_than_an_early_one(spark, folder, monkeypatch):
    """Batch 500 looks at as many folders as batch 100."""
    book = AnswerLedger(spark, folder, summed_every=8)
    book.freeze(spark.createDataFrame([("a",)] * 9, "uuid string"))
    written, read = {"answers/_SUCCESS"}, []
    monkeypatch.setattr(book, "_exists", lambda name: name.removesuffix("/_SUCCESS") in written)
    monkeypatch.setattr(book, "_forget", lambda before: None)

    class Counts:
        def __getattr__(self, _):
            return lambda *a, **k: self

    monkeypatch.setattr(book, "_left", lambda base, batch: read.append(batch - base) or Counts())
    looked = {}
    for batch in range(505):
        if batch and batch % 8 == 0:
            written.add(f"left/before={batch}")
        read.clear()
        book.remaining(batch)
        looked[batch] = sum(read)
    assert looked[500] == looked[100] == 4 and max(looked.values()) == 7


@pytest.mark.parametrize("within", [None, "10 minutes"])
def test_repeats_within_across_and_after_the_watermark(spark, folder, history_row, within):
    def put(start, *rows):
        topic = [(None, json.dumps({"msg_version": v, **history_row, "uuid": u}), "t", 0, start + i, t) for i, (u, v, t) in enumerate(rows)]
        times = spark.createDataFrame(topic, "key string, value string, topic string, partition int, offset bigint, timestamp string")
        times.withColumn("timestamp", times["timestamp"].cast("timestamp")).coalesce(1).write.mode("append").json(f"{folder}/topic")

    def run():
        ingest_history(
            spark.readStream.schema(TOPIC_SCHEMA).option("maxFilesPerTrigger", 1).json(f"{folder}/topic"),
            table=f"{folder}/history.parquet",
            dead_letters=f"{folder}/refused",
            checkpoint=f"{folder}/checkpoint",
            repeats_within=within,
        ).awaitTermination()
        return sorted(r["uuid"] for r in spark.read.parquet(f"{folder}/history.parquet").collect())

    def at(minute):
        return f"2024-01-01 {10 + minute // 60}:{minute % 60:02d}:00"

    # Within one batch, refused ones too; across batches; and after a restart.
    put(0, ("a", "1.1.0", at(0)), ("a", "1.1.0", at(1)), ("b", "1.1.0", at(2)), ("x", "0", at(2)), ("x", "0", at(2)))
    put(5, ("a", "1.1.0", at(6)), ("c", "1.1.0", at(7)))
    first = run()
    assert first == (["a", "a", "a", "b", "c"] if within is None else ["a", "b", "c"])
    put(7, ("c", "1.1.0", at(9)), ("d", "1.1.0", at(40)))
    assert run() == sorted(first + (["c", "d"] if within is None else ["d"]))
    # The watermark is beyond a by now: it is forgotten, and a new one is stored again.
    put(9, ("a", "1.1.0", at(41)), ("e", "1.1.0", at(41)))
    assert run() == sorted(first + (["a", "c", "d", "e"] if within is None else ["a", "d", "e"]))
    assert [r["reason"] for r in spark.read.parquet(f"{folder}/refused").collect()] == ["unsupported version: 0"] * 2


def test_state_of_days_is_that_of_all_rows(spark, folder, make_history):
    rng = random.Random(3)
    changes = []
    for i in range(400):
        day, key = rng.randint(0, 70), rng.randint(0, 4)
        time = f"2024-{1 + day // 31:02d}-{1 + day % 28:02d} {rng.randint(0, 23):02d}:{rng.randint(0, 59):02d}:00"
        status = rng.choice(["CREATE_FAILED", "CREATE_COMPLETE", "CREATE_IN_PROGRESS"])
        changes.append({"provider_name": f"p{key}", "submission_time": rng.choice([time, time, "never"]), "status": status, "completion_time_s": float(rng.randint(0, 9))})
    # A frame that begins at a row's instant, and one key with a single row.
    changes += [{"provider_name": "edge", "submission_time": t, "completion_time_s": 5.0} for t in ("2024-01-05 10:00:00", "2024-01-05 10:00:01", "2024-02-04 10:00:00")]
    changes += [{"provider_name": "lone", "submission_time": "2024-01-31 00:00:00"}]
    history = make_history(*changes)
    for batch in range(3):
        append_history(history.where(F.pmod(F.xxhash64("uuid"), F.lit(3)) == batch), f"{folder}/history", batch, partials=f"{folder}/days")
    append_history(history.where("uuid = 'u0'"), f"{folder}/history", 3, partials=f"{folder}/days")
    append_history(history.where("false"), f"{folder}/history", 3, partials=f"{folder}/days")  # a replay replaces
    found = current_state(spark, f"{folder}/history", f"{folder}/days")
    order = ["provider", "template_name"]
    wanted = latest_state(derive(clean(history))).select(*found.columns).orderBy(order).collect()
    got = found.orderBy(order).collect()
    assert len(got) == 7 and [tuple(r)[:3] for r in got] == [tuple(r)[:3] for r in wanted]
    for a, b in zip(got, wanted):
        assert tuple(a)[3:] == pytest.approx(tuple(b)[3:])
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "month" in plan.split("PartitionFilters", 1)[1]


def test_a_batch_keeps_its_texts_once_and_compressed(spark, folder, make_history, monkeypatch):
    """The settled batch is the only copy of the texts beside the answers, whose lines are compressed."""
    state = history_state(make_history({"provider_name": "good", "region_name": "r"}))
    copies = []

    def counted(df, **how):
        copies.extend(["value"] if "value" in df.columns else [])
        return settle(df, **how)

    monkeypatch.setattr(ranking, "settle", counted)
    send(spark, folder, 0, request("a", candidate("good"), candidate("bad")), request("b", candidate("x")), "no json")
    rank_stream(
        stream(spark, folder),
        answers=spark.createDataFrame([("b",)], "uuid string"),
        state=lambda _: state,
        sink=AnswerSink(path=f"{folder}/answers"),
        dead_letters=f"{folder}/refused",
        ledger=f"{folder}/ledger",
        checkpoint=f"{folder}/checkpoint",
    ).awaitTermination()
    assert copies == ["value"]
    files = [f for f in os.listdir(f"{folder}/answers/batch_id=0") if f.startswith("part-")]
    assert files and all(f.endswith(".txt.gz") for f in files)
    (answer,) = (json.loads(r["value"]) for r in spark.read.text(f"{folder}/answers").collect())
    assert [p["provider_name"] for p in answer["ranked_providers"]] == ["good", "bad"]
    assert answer["ranked_providers"][0].keys() >= {"gpus_requ", "classification"}
    assert spark.read.parquet(f"{folder}/refused").count() == 1


def test_a_batch_brings_texts_together_and_leaves_no_shuffle_files(spark, folder, make_history, monkeypatch):
    """What moves by message is its text, not its candidates, and goes with the batch."""
    state = history_state(make_history({"provider_name": "good", "region_name": "r"}))
    plans, modes = [], []

    def written(answers, *args, **how):
        modes.append(answers.sparkSession.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled"))
        plans.append(answers._jdf.queryExecution().executedPlan().toString())
        return write_answers(answers, *args, **how)

    monkeypatch.setattr(ranking, "write_answers", written)
    send(spark, folder, 0, request("a", candidate("good"), candidate("bad")), request("b", candidate("x")))
    rank_stream(
        stream(spark, folder),
        answers=spark.createDataFrame([("b",)], "uuid string"),
        state=lambda _: state,
        sink=AnswerSink(path=f"{folder}/answers"),
        dead_letters=f"{folder}/refused",
        ledger=f"{folder}/ledger",
        checkpoint=f"{folder}/checkpoint",
    ).awaitTermination()
    assert modes == ["true"]
    shuffles = [line for line in plans[0].split("\n") if "Exchange hashpartitioning" in line]
    assert len(shuffles) == 1 and plans[0].index("Exchange hashpartitioning") > plans[0].rindex("Generate ")
