from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from moorage.operators.answered import skip_answered


def expected(requests, answers):
    left, kept = Counter(answers), []
    for place, uuid in enumerate(requests):
        if left[uuid] > 0:
            left[uuid] -= 1
        else:
            kept.append(place)
    return kept


def found(spark, requests, answers, block):
    asked = spark.createDataFrame([(u, i, 0) for i, u in enumerate(requests)], "uuid string, offset bigint, partition int")
    given_answers = spark.createDataFrame([(a,) for a in answers], "uuid string")
    rows = skip_answered(asked.repartition(3), given_answers, block=block).collect()
    return sorted(r["offset"] for r in rows)


uuids = st.lists(st.sampled_from("abc"), max_size=25)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(uuids, uuids, st.sampled_from([1, 3, 1000]))
def test_bag_difference(spark, requests, answers, block):
    assert found(spark, requests, answers, block) == expected(requests, answers)


def test_one_uuid_for_most_requests(spark):
    requests = ["hot"] * 300 + ["cold"]
    assert found(spark, requests, ["hot"] * 120, 7) == expected(requests, ["hot"] * 120)
    assert found(spark, requests, ["hot"] * 500, 7) == [300]
