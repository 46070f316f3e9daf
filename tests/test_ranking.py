import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from moorage.functions.scores import duration_goodness
from moorage.operators.enrich import enrich
from moorage.operators.ranking import RankSpec, rank_candidates, with_rank
from moorage.operators.requests import route
from moorage.operators.scoring import any_missing, model_scores, void_messages
from moorage.plans.inference import RankJob, rank_messages
from moorage.schema import request_schema
from moorage.sources.topics import struct_messages

SCORED = """msg_id int, pos int, provider string, resource_exactness double, classification double,
regression double"""


def ranked(spark, rows, **spec):
    df = spark.createDataFrame([(0, i, *r) for i, r in enumerate(rows, 1)], SCORED)
    return rank_candidates(df, RankSpec(**spec)).orderBy("rank").collect()


def test_weights(spark):
    rows = ranked(spark, [("A", 2.0, 0.8, 0.2), ("B", 1.0, 0.6, 0.4)], weight=0.5, exact_first=False)
    assert (rows[0]["classification"], rows[0]["regression"]) == (0.4, 0.1)
    assert len(rows) == 2


def test_threshold(spark):
    rows = ranked(spark, [("A", 2.0, 0.9, 0.2), ("B", 1.0, 0.3, 0.1)], weight=0.6, threshold=0.5)
    assert [r["provider"] for r in rows] == ["A"]


def test_exactness_first(spark):
    rows = [("A", 0.0, 0.5, 0.5), ("B", 3.0, 0.5, 0.5)]
    assert [r["provider"] for r in ranked(spark, rows, weight=0.5)] == ["B", "A"]
    assert [r["provider"] for r in ranked(spark, rows, weight=0.5, exact_first=False)] == ["A", "B"]


def test_no_candidates(spark):
    assert ranked(spark, []) == []


def test_weight_must_be_a_share():
    with pytest.raises(ValueError):
        RankSpec(weight=1.0)


score = st.sampled_from([0.0, 0.25, 0.5, 1.0])


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(score, score, score), max_size=12), st.booleans())
def test_order_is_a_stable_descending_sort(spark, drawn, exact_first):
    rows = [(str(i), *r) for i, r in enumerate(drawn)]

    def key(r):
        total = r[2] * 0.75 + r[3] * 0.25
        return (r[1], total) if exact_first else total

    expected = [r[0] for r in sorted(rows, key=key, reverse=True)]
    assert [r["provider"] for r in ranked(spark, rows, exact_first=exact_first)] == expected


@pytest.mark.parametrize(
    "expected, low, high, value",
    [(15.0, 10.0, 20.0, 0.5), (5.0, 10.0, 20.0, 1.0), (99.0, 10.0, 20.0, 0.0), (3.0, 5.0, 0.0, 1.0), (3.0, 7.0, 7.0, 1.0)],
)
def test_duration_goodness(spark, expected, low, high, value):
    df = spark.createDataFrame([(expected, low, high)], "t double, lo double, hi double")
    assert df.select(duration_goodness(F.col("t"), F.col("lo"), F.col("hi"))).first()[0] == value


def test_goodness_of_nan_stays_nan(spark):
    df = spark.createDataFrame([(float("nan"), 1.0, 2.0)], "t double, lo double, hi double")
    assert df.where(F.isnan(duration_goodness(F.col("t"), F.col("lo"), F.col("hi")))).count() == 1


STATE = """provider string, template_name string, failure_percentage double, avg_success_time double,
avg_failure_time double, max_success_time double, min_success_time double"""


def test_every_candidate_sees_its_own_history(spark):
    state = spark.createDataFrame(
        [("p1-r", "t", 0.5, 5.0, 6.0, 9.0, 1.0), ("p2-r", "t", 0.25, 7.0, 8.0, 10.0, 2.0)], STATE
    )
    rows = [(1, "p1-r", "t"), (2, "p2-r", "t"), (3, "p3-r", "t"), (4, "p1-r", "other")]
    df = enrich(spark.createDataFrame(rows, "pos int, provider string, template_name string"), state)
    found = {r["pos"]: (r["failure_percentage"], r["max_success_time"]) for r in df.collect()}
    assert found == {1: (0.5, 9.0), 2: (0.25, 10.0), 3: (0.0, 0.0), 4: (0.0, 0.0)}


def test_one_unscorable_candidate_voids_its_message(spark):
    rows = [(1, 1.0, 0.3), (1, float("nan"), 0.4), (2, 1.0, 0.5)]
    df = spark.createDataFrame(rows, "msg_id int, f double, classification double")
    found = void_messages(df, any_missing(["f"]), column="classification").collect()
    assert sorted((r["msg_id"], r["classification"]) for r in found) == [(1, -1.0), (1, -1.0), (2, 0.5)]


def test_missing_models_score_minus_one(spark):
    df = spark.createDataFrame([(1, 2.0)], "msg_id int, f double")
    row = model_scores(df, classifier=None, regressor=None).first()
    assert (row["classification"], row["regression"]) == (-1.0, -1.0)


def candidate(name, instances=5.0, exact=3.0, **more):
    return {
        "provider_name": name,
        "region_name": "r",
        "n_instances_requ": instances,
        "exact_flavors": exact,
        "gpus_requ": 0.0,
        **more,
    }


def requests(spark, *lists):
    rows = [
        {"uuid": f"u{i}", "msg_version": "1.1.0", "template_name": "t", "providers": providers}
        for i, providers in enumerate(lists)
    ]
    text = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "msg_id int, value string")
    return text.select("msg_id", F.from_json("value", request_schema()).alias("b")).select("msg_id", "b.*")


def answer(spark, *lists, **spec):
    state = spark.createDataFrame(
        [("good-r", "t", 0.0, 5.0, 0.0, 9.0, 1.0), ("bad-r", "t", 1.0, 9.0, 0.0, 9.0, 1.0)], STATE
    )
    answers = rank_messages(requests(spark, *lists), state, job=RankJob(spec=RankSpec(**spec)))
    return {r["uuid"]: [p.asDict() for p in r["ranked_providers"]] for r in answers.collect()}


def test_messages_with_none_one_and_many_candidates(spark):
    found = answer(
        spark, [], [candidate("good")], [candidate("bad"), candidate("good")], [candidate("x", 0.0)]
    )
    assert sorted(found) == ["u1", "u2", "u3"]
    assert found["u1"][0]["classification"] == -1 and found["u1"][0]["resource_exactness"] == 0.6
    assert [p["provider_name"] for p in found["u2"]] == ["good", "bad"]
    assert found["u2"][0]["classification"] == 0.75
    assert found["u3"][0]["resource_exactness"] == 0.0


def test_all_filtered_out_still_answers(spark):
    assert answer(spark, [candidate("bad"), candidate("bad2")], threshold=5.0) == {"u0": []}


def test_repeated_provider_keeps_first_request_and_last_values(spark):
    first, last = candidate("new", exact=1.0), candidate("new", exact=5.0)
    found = answer(spark, [first, candidate("other", exact=2.0), last])["u0"]
    assert [p["provider_name"] for p in found] == ["new", "other"]
    assert found[0]["resource_exactness"] == 1.0 and found[0]["exact_flavors"] == 1.0


def test_routes(spark):
    df = route(requests(spark, [], [candidate("a")], [candidate("a"), candidate("b")]))
    assert [r["route"] for r in df.orderBy("msg_id").collect()] == ["none", "single", "scored"]


def test_answer_text_has_sorted_keys_and_no_absent_fields(spark):
    state = spark.createDataFrame([], STATE)
    answers = rank_messages(requests(spark, [candidate("b"), candidate("a")]), state)
    text = struct_messages(answers.select("uuid", "ranked_providers")).first()["value"]
    entry = json.loads(text)["ranked_providers"][0]
    assert text == json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"))
    assert "ram_gb_quota" not in entry and entry["provider_name"] == "b"


def test_unscorable_candidates_come_last(spark):
    nan = float("nan")
    scores = [(1, nan, 0.5), (2, 0.4, 0.2), (3, None, 0.9), (4, 0.6, 0.3), (5, 0.1, 0.1)]
    rows = [("m", pos, c, r, 1.0) for pos, c, r in scores]
    scored = spark.createDataFrame(rows, "msg_id string, pos int, classification double, regression double, resource_exactness double")
    every = with_rank(scored, RankSpec(weight=0.5)).orderBy("rank").collect()
    assert [r["pos"] for r in every] == [4, 2, 5, 1, 3]
    kept = rank_candidates(scored, RankSpec(weight=0.5, threshold=0.25)).orderBy("rank").collect()
    assert [r["pos"] for r in kept] == [4, 2]
