import pytest

from tests.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("4")


@pytest.fixture
def history_row():
    """One deployment with a value in every field."""
    return {
        "uuid": "uuid",
        "provider_name": "provider1",
        "region_name": "region1",
        "template_name": "tpl1",
        "user_group": "group",
        "status": "CREATE_COMPLETE",
        "status_reason": "ok",
        "submission_time": "2024-01-01",
        "vcpus_quota": 10.0,
        "vcpus_usage": 5.0,
        "vcpus_requ": 3.0,
        "ram_gb_quota": 32.0,
        "ram_gb_usage": 16.0,
        "ram_gb_requ": 8.0,
        "storage_gb_quota": 100.0,
        "storage_gb_usage": 50.0,
        "storage_gb_requ": 20.0,
        "n_instances_quota": 10.0,
        "n_instances_usage": 5.0,
        "n_instances_requ": 2.0,
        "n_volumes_quota": 50.0,
        "n_volumes_usage": 25.0,
        "n_volumes_requ": 10.0,
        "floating_ips_quota": 5.0,
        "floating_ips_usage": 2.0,
        "floating_ips_requ": 1.0,
        "gpus_requ": 1.0,
        "completion_time_s": 30.0,
        "tot_failure_time_s": 0.0,
        "exact_flavors": 1.0,
        "test_failure_perc_30d": 0.1,
        "test_failure_perc_7d": 0.1,
        "test_failure_perc_1d": 0.1,
        "overbooking_ram": 1.0,
        "overbooking_cpu": 1.0,
        "bandwidth_in": 10.0,
        "bandwidth_out": 10.0,
        "n_failures": 0,
    }


@pytest.fixture
def make_history(spark, history_row):
    from moorage.schema import history_schema

    def make(*changes):
        schema = history_schema("1.1.0")
        rows = [{**history_row, "uuid": f"u{i}", **change} for i, change in enumerate(changes)]
        return spark.createDataFrame([tuple(r[f] for f in schema.fieldNames()) for r in rows], schema)

    return make
