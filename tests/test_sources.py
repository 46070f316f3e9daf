import gzip
import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from moorage.plans.inference import rank_messages
from moorage.operators.requests import route
from moorage.schema import CANDIDATE_FIELDS, HISTORY_STATS, TOPIC_SCHEMA, history_schema
from moorage.settle import settled_for_now, shared_folder
from moorage.sources.history import HistorySource, read_history, read_history_files
from moorage.sources.messages import (
    AnswerSink,
    MessageSource,
    open_sources,
    publish_requests,
    read_answers,
    read_requests,
    request_messages,
    write_answers,
)
from moorage.sources.topics import (
    Tls,
    Topic,
    answer_messages,
    dump,
    history_messages,
    parse_requests,
    read_history_messages,
    read_ranges,
)
from moorage.sources.validation import accepted, check_columns, refused, with_history_reason, with_request_reason

STATE = "provider string, template_name string, timestamp timestamp_ntz, " + ", ".join(f"{c} double" for c in HISTORY_STATS)


def write(path, content):
    path.write_text(content if isinstance(content, str) else json.dumps(content))
    return str(path)


def test_csv(spark, tmp_path, history_row):
    names = list(history_row)
    text = ",".join(names) + "\n" + ",".join("" if n == "user_group" else str(history_row[n]) for n in names)
    df = read_history_files(spark, write(tmp_path / "h.CSV", text))
    assert df.columns == names and df.schema["n_failures"].dataType.simpleString() == "int"
    row = df.first()
    assert row["vcpus_quota"] == 10.0 and row["user_group"] is None and row["submission_time"] == "2024-01-01"


ROWS = [{"uuid": "a", "vcpus_quota": 1, "n_failures": 2.0}, {"uuid": "b", "vcpus_quota": 2.5}]


@pytest.mark.parametrize(
    "document",
    [
        ROWS,
        {"uuid": ["a", "b"], "vcpus_quota": [1, 2.5], "n_failures": [2, None]},
        {"uuid": {"0": "a", "1": "b"}, "vcpus_quota": {"0": 1, "1": 2.5}, "n_failures": {"0": 2}},
    ],
)
def test_json(spark, tmp_path, document):
    df = read_history_files(spark, write(tmp_path / "h.json", document))
    rows = sorted((r["uuid"], r["vcpus_quota"], r["n_failures"]) for r in df.collect())
    assert rows == [("a", 1.0, 2), ("b", 2.5, None)]


def test_refused_files(spark, tmp_path):
    with pytest.raises(ValueError, match="extension"):
        read_history_files(spark, "h.xml")
    with pytest.raises(ValueError, match="no history file"):
        read_history_files(spark, None)
    with pytest.raises(ValueError, match="version"):
        read_history_files(spark, write(tmp_path / "a.csv", "uuid\n1"), version="0.1")
    with pytest.raises(ValueError, match="colour"):
        read_history_files(spark, write(tmp_path / "b.csv", "uuid,colour\n1,red"))
    with pytest.raises(ValueError, match="colour"):
        read_history_files(spark, write(tmp_path / "c.json", [{"colour": "red"}]))
    with pytest.raises(ValueError):
        HistorySource()


def test_parquet_history(spark, tmp_path, make_history):
    rows = make_history({}, {"n_failures": 3})
    rows.write.parquet(str(tmp_path / "h.parquet"))
    df = read_history(spark, HistorySource(path=str(tmp_path / "h.parquet")))
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, rows.select(*df.columns).collect()))


def topic(spark, *values):
    rows = [(None, v if isinstance(v, str) else json.dumps(v), "t", 0, i, None) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, TOPIC_SCHEMA)


def test_history_messages_round_trip(spark, make_history):
    rows = make_history({}, {"n_failures": 3, "vcpus_usage": None})
    messages = history_messages(rows)
    text = messages.first()["value"]
    assert text == json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"))
    back = read_history_messages(messages)
    assert back.columns == history_schema("1.1.0").fieldNames()
    assert sorted(r["uuid"] + str(r["n_failures"]) for r in back.collect()) == ["u00", "u13"]


def test_columns_nobody_sends_are_absent(spark):
    df = read_history_messages(topic(spark, {"msg_version": "1.1.0", "uuid": "a"}, {"msg_version": "1.1.0", "status": "x"}))
    assert df.columns == ["uuid", "status"]


BAD = [
    ({"msg_version": "2", "uuid": "a"}, "unsupported version: 2"),
    ({"uuid": "a"}, "message has no version"),
    ({"msg_version": "1.1.0", "b": 1, "a": 2}, "invalid keys: a,b"),
    ("[1]", "not a JSON object"),
]


@pytest.mark.parametrize("message, reason", BAD)
def test_refused_history_messages(spark, message, reason):
    checked = with_history_reason(topic(spark, {"msg_version": "1.1.0", "uuid": "a"}, message))
    assert [r["reason"] for r in refused(checked).collect()] == [reason]
    assert accepted(checked).count() == 1
    with pytest.raises(ValueError, match=reason):
        read_history_messages(topic(spark, message))


ONE, TWO = [{"provider_name": "a", "odd": 1}], [{"provider_name": "a"}, {"provider_name": "b", "odd": 1}]


@pytest.mark.parametrize(
    "version, providers, reason",
    [
        ("1.1.0", [], "no providers"),
        ("9", ONE, None),
        ("9", TWO, "unsupported version: 9"),
        ("1.1.0", TWO, "invalid keys: odd"),
        ("1.1.0", [{"provider_name": "a"}] * 2, None),
    ],
)
def test_request_reasons(spark, version, providers, reason):
    message = {"uuid": "u", "msg_version": version, "template_name": "t", "providers": providers}
    assert with_request_reason(topic(spark, message)).first()["reason"] == reason


def test_parsed_request_keeps_its_place(spark):
    message = {"uuid": "u", "msg_version": "1.1.0", "template_name": "t", "providers": [{"gpus_requ": 1}]}
    row = parse_requests(topic(spark, message)).first()
    assert (row["uuid"], row["offset"], row["providers"][0]["gpus_requ"]) == ("u", 0, 1.0)


def test_request_and_answer_files(spark, tmp_path):
    path = write(tmp_path / "in.json", [{"uuid": "a", "providers": [{"gpus_requ": 1}]}, {"uuid": "b", "providers": []}])
    rows = read_requests(spark, path).orderBy("msg_id").collect()
    assert [r["uuid"] for r in rows] == ["a", "b"] and len({r["msg_id"] for r in rows}) == 2
    out = str(tmp_path / "out")
    schema = "uuid string, ranked_providers array<struct<provider_name string>>"
    answers = spark.createDataFrame([("a", [("p",)])], schema)
    write_answers(answers, AnswerSink(path=out))
    write_answers(answers, AnswerSink(path=out))
    assert [r["uuid"] for r in read_answers(spark, out).collect()] == ["a", "a"]
    with pytest.raises(ValueError):
        AnswerSink()
    with pytest.raises(ValueError):
        read_requests(spark, None)


def test_topic_options():
    whole = Topic("training", client="c", max_offsets_per_trigger=5)
    assert whole.read_options() == {
        "kafka.bootstrap.servers": "localhost:9092",
        "kafka.client.id": "c",
        "kafka.fetch.max.bytes": "104857600",
        "subscribe": "training",
        "startingOffsets": "earliest",
    }
    assert whole.stream_options()["maxOffsetsPerTrigger"] == "5"
    assert whole.trigger() == {"processingTime": "0 seconds"}
    part = Topic("training", partition=2, offset=7, timeout_ms=1000)
    assert json.loads(part.read_options()["assign"]) == {"training": [2]}
    assert json.loads(part.read_options()["startingOffsets"]) == {"training": {"2": 7}}
    assert part.trigger() == {"availableNow": True}
    written = Topic("out").write_options()
    assert written["topic"] == "out" and written["kafka.acks"] == "all"
    assert written["kafka.enable.idempotence"] == "true" and written["kafka.max.request.size"] == "104857600"
    with pytest.raises(ValueError):
        Topic("t", partition=-1)


def test_ends_of_topics(spark):
    assert "endingOffsets" not in Topic("t").batch_options()
    part = Topic("t", partition=2, offset=7, end=9)
    assert json.loads(part.batch_options()["endingOffsets"]) == {"t": {"2": 9}} and "endingOffsets" not in part.read_options()
    messages = spark.createDataFrame([(0, 5), (0, 9), (3, 0)], "partition int, offset bigint")
    again = Topic("t", ranges=read_ranges(messages)).batch_options()
    assert json.loads(again["assign"]) == {"t": [0, 3]}
    assert json.loads(again["startingOffsets"]) == {"t": {"0": 5, "3": 0}} and json.loads(again["endingOffsets"]) == {"t": {"0": 10, "3": 1}}
    for wrong in ({"end": 3}, {"partition": 0, "offset": 4, "end": 3}, {"ranges": {0: (2, 1)}}, {"partition": 0, "ranges": {0: (0, 1)}}):
        with pytest.raises(ValueError):
            Topic("t", **wrong)
    with pytest.raises(ValueError, match="no end"):
        part.stream_options()


def test_opening_requests_and_answers(spark, tmp_path, monkeypatch):
    asked = write(tmp_path / "asked.json", [{"uuid": "a", "providers": [{"gpus_requ": 1}]}])
    given = write(tmp_path / "given.json", [{"uuid": "a"}, {"uuid": "b"}])
    opened = []
    monkeypatch.setattr(Topic, "read", lambda self, _: opened.append(("read", self.name)) or topic(spark, {"uuid": "z"}, {"no": 1}))
    monkeypatch.setattr(Topic, "read_stream", lambda self, _: opened.append(("stream", self.name)) or topic(spark, {"uuid": "y"}))

    def both(requests, answers):
        opened.clear()
        q, a = open_sources(spark, MessageSource(**requests), MessageSource(**answers))
        return sorted(json.loads(r["value"])["uuid"] for r in q.collect() if "uuid" in r["value"]), sorted(r["uuid"] for r in a.collect())

    assert both({"path": asked}, {"path": given}) == (["a"], ["a", "b"]) and opened == []
    assert both({"topic": Topic("q")}, {"topic": Topic("a")}) == (["y"], ["z"]) and opened == [("stream", "q"), ("read", "a")]
    assert both({"topic": Topic("q", timeout_ms=5)}, {"path": given}) == (["z"], ["a", "b"]) and opened == [("read", "q")]
    assert both({"path": asked}, {"topic": Topic("a")}) == (["a"], ["z"]) and opened == [("read", "a")]
    for wrong in ({}, {"path": "p", "topic": Topic("t")}):
        with pytest.raises(ValueError):
            MessageSource(**wrong)


def test_published_requests_are_read_back(spark, monkeypatch):
    sent = []
    monkeypatch.setattr(Topic, "write", lambda self, messages: sent.append((self.name, messages)))
    text = {"uuid": "u", "msg_version": "1.1.0", "template_name": "t", "providers": [{"provider_name": "p", "gpus_requ": 1}, {"provider_name": "q"}]}
    publish_requests(parse_requests(topic(spark, text)), Topic("asked"))
    assert sent[0][0] == "asked"
    row = parse_requests(sent[0][1]).first()
    assert (row["uuid"], row["template_name"], [p["provider_name"] for p in row["providers"]], row["providers"][0]["gpus_requ"]) == ("u", "t", ["p", "q"], 1.0)


def test_entries_go_out_as_they_came(spark):
    entry = {"provider_name": "p", "region_name": "r", "hobby": {"b": [1, None, {"c": "x,\"y"}]}, "gpus_requ": None, "vcpus_usage": 1.5}
    odd = {"regression": "mine", "classification": [1], "resource_exactness": {"a": 1}}
    messages = [{"uuid": f"u{i}", "msg_version": "1.1.0", "template_name": "t", "providers": p} for i, p in enumerate([[entry], [odd], [{}], [entry, {**entry, "provider_name": "q"}]])]
    answers = rank_messages(parse_requests(topic(spark, *messages)).withColumn("msg_id", F.col("offset")), spark.createDataFrame([], STATE))
    got = {m["uuid"]: m["ranked_providers"] for m in (json.loads(r["value"]) for r in answer_messages(answers).collect())}
    scores = {"classification": -1.0, "regression": -1.0, "resource_exactness": 0.0}
    assert got["u0"] == [{**scores, **entry}] and got["u1"] == [odd] and got["u2"] == [scores]
    assert [list(p) for p in got["u0"]] == [[*scores, *entry]]
    assert [{k: p[k] for k in entry} for p in got["u3"]] == [entry, {**entry, "provider_name": "q"}]
    assert all(p["classification"] == 0.75 and p["regression"] == 0.25 for p in got["u3"])


def test_tls_options():
    with pytest.raises(ValueError, match="password"):
        Topic("t", tls=Tls(ca="ca.pem")).read_options()
    options = Topic("t", tls=Tls("ca.pem", "both.pem", "both.pem", "secret")).write_options()
    assert options["kafka.security.protocol"] == "SSL"
    assert options["kafka.ssl.endpoint.identification.algorithm"] == ""
    assert options["kafka.ssl.truststore.location"] == "ca.pem"
    assert options["kafka.ssl.keystore.location"] == "both.pem"


def test_dump(spark):
    assert tuple(dump(topic(spark, "x")).first()) == ("x", 0, 0)


def test_fewer_columns_are_fine():
    check_columns(["uuid", "status"], "1.1.0")


def test_json_lines_of_several_records(spark, tmp_path):
    lines = "\n".join(json.dumps({"uuid": f"u{i}", "vcpus_quota": i, "n_failures": 1}) for i in range(5))
    path = tmp_path / "lines.json"
    path.write_text(lines + "\n\n")
    assert sorted(r["uuid"] for r in read_history_files(spark, str(path)).collect()) == [f"u{i}" for i in range(5)]
    requests = tmp_path / "requests.json"
    requests.write_text("\n".join(json.dumps({"uuid": f"r{i}", "providers": []}) for i in range(4)))
    assert read_requests(spark, str(requests)).count() == 4


@pytest.mark.parametrize("as_lines", [True, False])
def test_requests_of_files_are_checked_like_those_of_topics(spark, tmp_path, as_lines):
    good = {f: 1 for f in CANDIDATE_FIELDS}
    fine = {"uuid": "a", "msg_version": "1.1.0", "template_name": "t", "providers": [good, good]}
    defects = {
        "unsupported version: 9.9": {**fine, "msg_version": "9.9"},
        "invalid keys: hobby": {**fine, "providers": [good, {"hobby": 1}]},
        "missing keys: uuid": {k: v for k, v in fine.items() if k != "uuid"},
        "missing keys: exact_flavors": {**fine, "providers": [{k: v for k, v in good.items() if k != "exact_flavors"}] * 2},
    }
    for k, (reason, message) in enumerate({None: fine, **defects}.items()):
        rows = [fine, message]
        text = "\n".join(map(json.dumps, rows)) if as_lines else json.dumps(rows, indent=1)
        path = write(tmp_path / f"{k}.json", text)
        found = sorted(str(r["reason"]) for r in with_request_reason(request_messages(spark, path), required=CANDIDATE_FIELDS).collect())
        assert found == sorted(["None", str(reason)])
        if reason is None:
            assert [r["uuid"] for r in read_requests(spark, path).collect()] == ["a", "a"]
        else:
            with pytest.raises(ValueError, match="refused"):
                read_requests(spark, path)


@pytest.mark.parametrize("text", ['[{"uuid": "a"}]\n[{"uuid": "b"}]', '{"uuid": "a"}\n{"uuid": ', '{"uuid":\n"a"}\n{"uuid":\n"b"}', "uuid"])
def test_json_that_would_be_read_in_part_is_refused(spark, tmp_path, text):
    path = tmp_path / "bad.json"
    path.write_text(text)
    for read in (read_history_files, read_answers, read_requests):
        with pytest.raises(ValueError, match="neither"):
            read(spark, str(path))


def test_answers_of_many_rows_come_back(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = [(f"a{i}", [(f"p{i}",)]) for i in range(50)]
    answers = spark.createDataFrame(rows, "uuid string, ranked_providers array<struct<provider_name string>>")
    write_answers(answers.coalesce(2), AnswerSink(path=out))
    assert sorted(r["uuid"] for r in read_answers(spark, out).collect()) == sorted(r[0] for r in rows)


def test_csv_as_it_is_written(spark, tmp_path):
    """Doubled quotes, newlines in quotes, and files with their columns in another order."""
    folder = tmp_path / "many.csv"
    folder.mkdir()
    (folder / "a.csv").write_text('uuid,status_reason,vcpus_quota\nu1,"bad ""x"", quota",1\nu2,"two\nlines",2\n')
    (folder / "b.csv").write_text("vcpus_quota,uuid\n3,u3\n")
    rows = {r["uuid"]: (r["status_reason"], r["vcpus_quota"]) for r in read_history_files(spark, str(folder)).collect()}
    assert rows == {"u1": ('bad "x", quota', 1.0), "u2": ("two\nlines", 2.0), "u3": (None, 3.0)}


def test_label_maps_keep_all_labels(spark, tmp_path):
    labels = [str(i) for i in range(3000)]
    document = {"uuid": {k: f"u{k}" for k in labels}, "vcpus_quota": {k: int(k) for k in labels[:-1]}, "n_failures": {k: 1 for k in labels}}
    path = tmp_path / "maps.json"
    path.write_text(json.dumps(document))
    rows = read_history_files(spark, str(path)).collect()
    assert {(r["uuid"], r["vcpus_quota"], r["n_failures"]) for r in rows} == {(f"u{k}", float(k) if k != "2999" else None, 1) for k in labels}


def test_columns_that_a_document_lacks_are_empty(spark, tmp_path):
    folder = tmp_path / "lists.json"
    folder.mkdir()
    (folder / "a.json").write_text('{"uuid": ["a", "b"], "vcpus_quota": [1, 2]}')
    (folder / "b.json").write_text('{"uuid": ["c"], "n_failures": [3]}')
    rows = sorted((r["uuid"], r["vcpus_quota"], r["n_failures"]) for r in read_history_files(spark, str(folder)).collect())
    assert rows == [("a", 1.0, None), ("b", 2.0, None), ("c", None, 3)]


def test_what_documents_hold_is_told_without_a_type_of_each_label(spark, tmp_path):
    from moorage.sources.jsonfiles import layout

    cases = {
        "labels": [{"uuid": {f"{d}-{i}": "u" for i in range(100)}, "n_failures": {}} for d in range(3)],
        "list": [{"uuid": ["u"], "n_failures": []}],
        "value": [{"uuid": "[1]", "status_reason": "{x}", "n_failures": None}, [{"uuid": "b"}]],
    }
    for kind, documents in cases.items():
        folder = tmp_path / f"{kind}.json"
        folder.mkdir()
        for k, document in enumerate(documents):
            (folder / f"{k}.json").write_text(json.dumps(document))
        names, kinds = layout(spark, str(folder), True, ["uuid", "n_failures", "status_reason"])
        assert ({"uuid", "n_failures"} <= set(names), kinds) == (True, {kind})
    (tmp_path / "mixed.json").write_text('{"uuid": ["a"], "n_failures": {"0": 1}}')
    with pytest.raises(ValueError, match="labelled values"):
        read_history_files(spark, str(tmp_path / "mixed.json"))


def test_names_of_accepted_messages_come_with_their_check(spark):
    from moorage.sources.validation import with_history_reason

    texts = ['{"msg_version":"1.1.0","uuid":"a"}', '{"msg_version":"1.1.0","z":1,"colour":1}', '{"uuid":"a"}', "[]"]
    rows = with_history_reason(spark.createDataFrame([(t,) for t in texts], "value string"), names="names").collect()
    assert [(r["names"], r["reason"]) for r in rows] == [
        ("msg_version,uuid", None),
        (None, "invalid keys: colour,z"),
        (None, "message has no version"),
        (None, "not a JSON object"),
    ]


def test_candidates_are_parsed_once_however_often_they_are_looked_at(spark):
    sent = spark.createDataFrame([(1, '{"uuid":"u","template_name":"t","msg_version":"1.1.0","providers":[{"provider_name":"a","gpus_requ":2}]}')], "msg_id int, value string")
    routed = route(parse_requests(sent)).where("route <> 'none'")
    plan = routed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 2  # the request, and each candidate's fields
    (r,) = routed.collect()
    assert (r["route"], r["providers"][0]["gpus_requ"], r["providers"][0]["sent"]) == ("single", 2.0, '{"provider_name":"a","gpus_requ":2}')


def test_answers_look_at_the_names_of_an_entry_once(spark):
    entry = "struct<sent string, classification double, regression double, resource_exactness double>"
    rows = [("u", [('{"a":1}', 0.5, None, 1.0), ('{"regression":"own"}', 0.5, 0.25, 1.0), ("{}", 0.5, 0.25, None), (' {"a":{}}', None, None, None)])]
    answers = answer_messages(spark.createDataFrame(rows, f"uuid string, ranked_providers array<{entry}>"))
    plan = answers._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("jsonObjectKeys") + plan.count("json_object_keys") == 1
    wanted = ['{"classification":0.5,"resource_exactness":1.0,"a":1}', '{"classification":0.5,"resource_exactness":1.0,"regression":"own"}', '{"classification":0.5,"regression":0.25}', '{"a":{}}']
    assert answers.first()["value"] == f'{{"ranked_providers":[{",".join(wanted)}],"uuid":"u"}}'


@pytest.mark.parametrize(
    "providers, reason",
    [
        ('[{"provider_name":"a"},{"gpus_requ":{"y":1,"y":2}}]', None),
        ('[{"provider_name":"a"},{"q":{"y":1,"y":2}}]', "invalid keys: q"),
        ('[{"provider_name":"a"},5]', "no providers"),
        ('[{"provider_name":"a"},"{}"]', "no providers"),
        ('[{"gpus_requ":1,"gpus_requ":2},{"gpus_requ":1e400}]', None),
    ],
)
def test_values_do_not_count_where_names_are_checked(spark, providers, reason):
    text = f'{{"uuid":"u","template_name":"t","msg_version":"1.1.0","providers":{providers}}}'
    checked = with_request_reason(spark.createDataFrame([(text,)], "value string"))
    assert checked.first()["reason"] == reason
    assert "map<string,variant>" in checked._jdf.queryExecution().analyzed().toString().lower() or "VariantType" in checked._jdf.queryExecution().analyzed().toString()


def test_rows_of_many_documents_are_not_dealt_out_again(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    for name, files in (("one", 1), ("many", cores)):
        folder = tmp_path / f"{name}.json"
        folder.mkdir()
        for k in range(files):
            with gzip.open(folder / f"{k}.json.gz", "wt") as f:
                json.dump([{"uuid": f"{k}-{i}", "n_failures": i} for i in range(3)], f, indent=1)
        found = read_history_files(spark, str(folder))
        assert ("RoundRobin" in found._jdf.queryExecution().executedPlan().toString()) == (files < cores)
        assert sorted(r["uuid"] for r in found.collect()) == sorted(f"{k}-{i}" for k in range(files) for i in range(3))


def test_history_files_are_compressed_and_leave_nothing_else(spark, make_history):
    from queries.registered import _write_history_files

    folder = f"{shared_folder(spark)}/history-{uuid.uuid4().hex}"
    before = {f for f in os.listdir(shared_folder(spark).removeprefix("file:")) if f.startswith("settled-")}
    with settled_for_now(spark):
        _write_history_files(make_history({}, {"uuid": "u0"}, {"template_name": 'a "b"'}), folder)
    assert {f for f in os.listdir(shared_folder(spark).removeprefix("file:")) if f.startswith("settled-")} <= before
    for name in ("rows.csv", "rows.json", "array.json", "labels.json"):
        files = [f for f in os.listdir(f"{folder.removeprefix('file:')}/{name}") if f.startswith("part-")]
        assert files and all(f.endswith(".gz") for f in files)
        assert read_history_files(spark, f"{folder}/{name}").where("status_reason IS NOT NULL").count() == 3
