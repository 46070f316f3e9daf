"""Message fields, versions and the derived columns every other module builds on."""

from __future__ import annotations

from pyspark.sql import types as T

# Names of the fields a deployment message of version 1.1.0 may carry.
TEXT_FIELDS = [
    "uuid",
    "provider_name",
    "region_name",
    "template_name",
    "user_group",
    "status",
    "status_reason",
    "submission_time",
]
NUMBER_FIELDS = [
    "vcpus_quota",
    "vcpus_usage",
    "vcpus_requ",
    "ram_gb_quota",
    "ram_gb_usage",
    "ram_gb_requ",
    "storage_gb_quota",
    "storage_gb_usage",
    "storage_gb_requ",
    "n_instances_quota",
    "n_instances_usage",
    "n_instances_requ",
    "n_volumes_quota",
    "n_volumes_usage",
    "n_volumes_requ",
    "floating_ips_quota",
    "floating_ips_usage",
    "floating_ips_requ",
    "gpus_requ",
    "completion_time_s",
    "tot_failure_time_s",
    "exact_flavors",
    "test_failure_perc_30d",
    "test_failure_perc_7d",
    "test_failure_perc_1d",
    "overbooking_ram",
    "overbooking_cpu",
    "bandwidth_in",
    "bandwidth_out",
]
COUNT_FIELDS = ["n_failures"]
VERSION_FIELD = "msg_version"

# Deployment outcomes and their class labels.
OUTCOMES = {"CREATE_COMPLETE": 0, "CREATE_FAILED": 1}
SUCCEEDED, FAILED = 0, 1

# Derived difference column -> resource prefix (quota - usage - request).
RESOURCE_DIFFS = {
    "cpu_diff": "vcpus",
    "ram_diff": "ram_gb",
    "storage_diff": "storage_gb",
    "instances_diff": "n_instances",
    "volumes_diff": "n_volumes",
    "floatingips_diff": "floating_ips",
}

#: What a request must name, and what some of its candidates must carry to be compared.
REQUEST_FIELDS = ["uuid", "template_name"]
CANDIDATE_FIELDS = [
    "provider_name",
    "region_name",
    *(f"{prefix}_{part}" for prefix in RESOURCE_DIFFS.values() for part in ("quota", "usage", "requ")),
    "gpus_requ",
    "exact_flavors",
]

# The five rolling statistics.
HISTORY_STATS = [
    "failure_percentage",
    "avg_success_time",
    "avg_failure_time",
    "max_success_time",
    "min_success_time",
]

# Default model inputs and targets.
DEFAULT_FEATURES = [
    "cpu_diff",
    "ram_diff",
    "storage_diff",
    "instances_diff",
    "floatingips_diff",
    "gpu",
    "test_failure_perc_30d",
    "overbooking_ram",
    "avg_success_time",
    "avg_failure_time",
    "failure_percentage",
    "complexity",
]
CLASS_TARGET = "status"
DURATION_TARGET = "deployment_time"

#: Beside the typed fields of a candidate that came as text: the whole entry as it was sent.
AS_SENT = "sent"

NO_PREDICTION = -1.0
SCORE_FIELDS = ["classification", "regression", "resource_exactness"]

#: (provider, template): the grouping of all history.
HISTORY_KEYS = ["provider", "template_name"]


def _history_struct() -> T.StructType:
    fields = [T.StructField(name, T.StringType()) for name in TEXT_FIELDS]
    fields += [T.StructField(name, T.DoubleType()) for name in NUMBER_FIELDS]
    fields += [T.StructField(name, T.IntegerType()) for name in COUNT_FIELDS]
    return T.StructType(fields)


#: Message version -> columns a history row of that version may have.
HISTORY_SCHEMAS: dict[str, T.StructType] = {"1.1.0": _history_struct()}


def history_schema(version: str) -> T.StructType:
    if version not in HISTORY_SCHEMAS:
        raise ValueError(f"version {version!r} is not supported; known: {sorted(HISTORY_SCHEMAS)}")
    return HISTORY_SCHEMAS[version]


def parsing_schema(version: str) -> T.StructType:
    """The same columns with whole numbers as doubles: JSON may write a count as ``1.0``."""
    return T.StructType(
        [
            T.StructField(f.name, T.DoubleType() if f.name in COUNT_FIELDS else f.dataType)
            for f in history_schema(version)
        ]
    )


def request_schema(version: str = "1.1.0") -> T.StructType:
    """One placement request: a template wanted by a user, and its candidate providers."""
    return T.StructType(
        [
            T.StructField("uuid", T.StringType()),
            T.StructField(VERSION_FIELD, T.StringType()),
            T.StructField("template_name", T.StringType()),
            T.StructField("providers", T.ArrayType(parsing_schema(version))),
        ]
    )


#: Row shape of a topic, as the Kafka source delivers it.
TOPIC_SCHEMA = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)
