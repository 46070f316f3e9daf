import pytest
from pyspark.sql import functions as F

from moorage.operators.cleaning import clean, derive


def test_derived_properties(make_history):
    row = derive(clean(make_history({})), complex_templates=["tpl1"]).first()
    assert row["provider"] == "provider1-region1"
    assert row["cpu_diff"] == 2 and row["ram_diff"] == 8 and row["storage_diff"] == 30
    assert row["instances_diff"] == 3 and row["volumes_diff"] == 15 and row["floatingips_diff"] == 2
    assert row["gpu"] == 1 and row["complexity"] == 1
    assert row["status"] == 0 and row["deployment_time"] == 30


def test_no_complex_templates(make_history):
    assert derive(clean(make_history({}))).first()["complexity"] == 0


@pytest.mark.parametrize(
    "change, expected",
    [
        ({"completion_time_s": 0.0, "tot_failure_time_s": 9.0, "n_failures": 2}, 4.5),
        ({"completion_time_s": 7.0, "tot_failure_time_s": 9.0, "n_failures": 2}, 7.0),
        ({"completion_time_s": 0.0, "tot_failure_time_s": 9.0, "n_failures": 0}, None),
        ({"completion_time_s": float("nan")}, None),
        ({"bandwidth_in": None}, None),
        ({"status": "CREATE_IN_PROGRESS"}, None),
        ({"submission_time": "someday"}, None),
    ],
)
def test_deployment_time_and_dropped_rows(make_history, change, expected):
    rows = clean(make_history(change)).collect()
    assert [r["deployment_time"] for r in rows] == ([] if expected is None else [expected])


def test_identity_columns_may_be_null(make_history):
    changes = {"uuid": None, "status_reason": None, "user_group": None}
    assert clean(make_history(changes)).count() == 1


def test_missing_identity_columns_are_an_error(make_history):
    with pytest.raises(ValueError, match="user_group"):
        clean(make_history({}).drop("user_group"))


def test_required_narrows_the_test(make_history):
    rows = make_history({"bandwidth_in": None})
    assert clean(rows, required=["vcpus_quota"]).count() == 1


def test_extra_time_formats(make_history):
    rows = clean(make_history({"submission_time": "03/02/2024"}), time_formats=["dd/MM/yyyy"])
    assert str(rows.select(F.to_date("timestamp")).first()[0]) == "2024-02-03"
