"""The SQL each registered query is checked against."""

from __future__ import annotations

from moorage.schema import HISTORY_SCHEMAS, HISTORY_STATS, NUMBER_FIELDS, RESOURCE_DIFFS
from queries.views import view_sql

COMPLEX = ("PROMO", "MEDIUM")
SCALED = ["cpu_diff", "ram_diff", "storage_diff", "gpu", "deployment_time"]
FENCED = ["cpu_diff", "ram_diff", "storage_diff", "instances_diff", "deployment_time"]
THRESHOLD = 0.9


def _frame(days: int) -> str:
    return f"RANGE BETWEEN INTERVAL '{days - 1} days 23:59:59.999999' PRECEDING AND CURRENT ROW"


def _stats(window: str) -> str:
    ok, ko = "CASE WHEN status = 0 THEN deployment_time END", "CASE WHEN status = 1 THEN deployment_time END"
    fast = "CASE WHEN status = 0 AND completion_time_s > 0 THEN deployment_time END"
    return f"""
  avg(cast(status AS double)) OVER {window} AS failure_percentage,
  coalesce(avg({ok}) OVER {window}, 0.0E0) AS avg_success_time,
  coalesce(avg({ko}) OVER {window}, 0.0E0) AS avg_failure_time,
  coalesce(max({ok}) OVER {window}, 0.0E0) AS max_success_time,
  coalesce(min({fast}) OVER {window}, 0.0E0) AS min_success_time"""


_CHECKED = ["provider_name", "region_name", "template_name", "submission_time", "n_failures", *NUMBER_FIELDS]
_NOT_NULL = " AND ".join(f"{c} IS NOT NULL" for c in [*_CHECKED, "status", "timestamp", "deployment_time"])
_DIFFS = ", ".join(f"{p}_quota - {p}_usage - {p}_requ AS {name}" for name, p in RESOURCE_DIFFS.items())
_COMPLEX = ", ".join(f"'{t}'" for t in COMPLEX)
_STATS = ", ".join(HISTORY_STATS)

_CTES = {
    "deployments": view_sql("deployments", "VARCHAR"),
    "requests": view_sql("requests", "VARCHAR"),
    "processed": view_sql("processed", "VARCHAR"),
    "predictions": view_sql("predictions", "VARCHAR"),
    "durations": view_sql("durations", "VARCHAR"),
    "events_history": view_sql("events_history", "VARCHAR"),
    "topic_messages": view_sql("topic_messages", "VARCHAR"),
    "labelled": """
SELECT * EXCLUDE (status, user_group, status_reason),
  CASE status WHEN 'CREATE_COMPLETE' THEN 0 WHEN 'CREATE_FAILED' THEN 1 END AS status,
  try_cast(submission_time AS timestamp) AS timestamp,
  CASE WHEN completion_time_s <> 0 THEN completion_time_s
       WHEN n_failures <> 0 THEN tot_failure_time_s / n_failures END AS deployment_time
FROM deployments""",
    "cleaned": f"SELECT * FROM labelled WHERE {_NOT_NULL}",
    "derived": f"""
SELECT *, concat(provider_name, '-', region_name) AS provider, {_DIFFS}, gpus_requ AS gpu,
  CASE WHEN template_name IN ({_COMPLEX}) THEN 1 ELSE 0 END AS complexity
FROM cleaned""",
    "rolled": f"""
SELECT *, {_stats("w")} FROM derived
WINDOW w AS (PARTITION BY provider, template_name ORDER BY timestamp {_frame(30)})""",
    "state": f"""
SELECT provider, template_name, timestamp, {_STATS} FROM rolled
QUALIFY row_number() OVER (PARTITION BY provider, template_name ORDER BY timestamp DESC) = 1""",
    "described": f"""
SELECT *, concat(provider_name, '-', region_name) AS provider, {_DIFFS}, gpus_requ AS gpu,
  CASE WHEN n_instances_requ > 0 THEN exact_flavors / n_instances_requ ELSE 0.0E0 END AS resource_exactness,
  count(*) OVER (PARTITION BY msg_id) AS n_candidates
FROM requests""",
    "merged": """
SELECT * EXCLUDE (pos), min(pos) OVER (PARTITION BY msg_id, provider) AS pos
FROM described WHERE n_candidates > 1
QUALIFY row_number() OVER (PARTITION BY msg_id, provider ORDER BY described.pos DESC) = 1""",
    "enriched": "SELECT m.*, "
    + ", ".join(f"coalesce(s.{c}, 0.0E0) AS {c}" for c in HISTORY_STATS)
    + """
FROM merged m LEFT JOIN state s ON m.provider = s.provider AND m.template_name = s.template_name""",
    "scored": """
SELECT *, 1 - failure_percentage AS p_success,
  CASE WHEN max_success_time > 0 AND max_success_time <> min_success_time
       THEN least(greatest(1 - (avg_success_time - min_success_time)
                                / (max_success_time - min_success_time), 0.0E0), 1.0E0)
       ELSE 1.0E0 END AS goodness
FROM enriched""",
    "weighed": """
SELECT *, p_success * 0.75E0 AS classification, goodness * 0.25E0 AS regression FROM scored""",
}

_NEEDS = {
    "labelled": ["deployments"],
    "cleaned": ["labelled"],
    "derived": ["cleaned"],
    "rolled": ["derived"],
    "state": ["rolled"],
    "described": ["requests"],
    "merged": ["described"],
    "enriched": ["merged", "state"],
    "scored": ["enriched"],
    "weighed": ["scored"],
}


def with_ctes(names: list[str], query: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, []):
            add(needed)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    ctes = ",\n".join(f"{name} AS ({_CTES[name]})" for name in order)
    return f"WITH {ctes}\n{query}"


_RANKED_COLUMNS = "msg_id, provider, cast(pos AS integer) AS pos, classification, regression, resource_exactness"
_BY_EXACTNESS = "resource_exactness DESC, classification + regression DESC, pos"
_BY_SCORE = "classification + regression DESC, pos"


def _ranking(order: str, where: str = "true") -> str:
    return with_ctes(
        ["weighed"],
        f"""
SELECT {_RANKED_COLUMNS},
  cast(row_number() OVER (PARTITION BY msg_id ORDER BY {order}) AS integer) AS rank
FROM weighed WHERE {where}""",
    )


def _quantiles(columns: list[str], table: str) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{c}' AS feature, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2, "
        f"quantile_cont({c}, 0.75) AS q3 FROM {table}"
        for c in columns
    )


_INSIDE = " AND ".join(
    f"(SELECT {c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) FROM q WHERE feature = '{c}')"
    for c in FENCED
)
_SCALING = ", ".join(
    f"round(({c} - (SELECT q2 FROM q WHERE feature = '{c}')) / (SELECT CASE WHEN q3 = q1 THEN 1.0E0 "
    f"ELSE q3 - q1 END FROM q WHERE feature = '{c}'), 6) AS {c}"
    for c in SCALED
)

_ALLOWED = ", ".join(f"'{c}'" for c in HISTORY_SCHEMAS["1.1.0"].fieldNames())
_JSON_FIELDS = sorted(["msg_version", *HISTORY_SCHEMAS["1.1.0"].fieldNames()])
_JSON_OBJECT = ", ".join(f"'{c}', " + ("'1.1.0'" if c == "msg_version" else c) for c in _JSON_FIELDS)

_COUNTS = """
SELECT count(*) FILTER (y = 1 AND y_hat = 1) AS tp, count(*) FILTER (y = 0 AND y_hat = 1) AS fp,
  count(*) FILTER (y = 1 AND y_hat = 0) AS fn, count(*) FILTER (y = 0 AND y_hat = 0) AS tn
FROM predictions"""


def _share(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} = 0 THEN 0.0E0 ELSE ({part}) / cast({whole} AS double) END"


def _class_rows(hit: str, wrong: str, missed: str, name: str) -> str:
    return f"""
SELECT '{name}' AS class, {_share(hit, f"({hit} + {wrong})")} AS precision,
  {_share(hit, f"({hit} + {missed})")} AS recall,
  {_share(f"2 * {hit}", f"(2 * {hit} + {wrong} + {missed})")} AS f1, {hit} + {missed} AS support FROM c"""


_ANSWERED_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate"

#: The order that splits and folds follow: 60 bits of the md5 of the seed and the id.
HASH = "cast('0x' || substr(md5('42' || chr(31) || uuid), 1, 15) AS bigint)"
_UNSCORABLE = "CASE WHEN n_instances_requ = 6 OR n_instances_requ = 5 THEN NULL ELSE classification + regression END"

#: A request's only candidate as text: a nested field, an explicit null, and at times a field of a score's name.
LONE_ENTRY = """concat('{{"provider_name":"', provider_name, '","hobby":{{"a":[1,2,null],"b":"x y"}},"exact_flavors":',
  cast(cast(exact_flavors AS int) AS {S}), ',"n_instances_requ":4,"gpus_requ":null,"region_name":"', region_name, '"',
  CASE WHEN msg_id % 3 = 0 THEN ',"classification":"mine"' ELSE '' END, '}}')"""


def _unscorable(mode: str, where: str) -> str:
    return f"""
SELECT msg_id, provider, cast(row_number() OVER (PARTITION BY msg_id
    ORDER BY resource_exactness DESC, total DESC NULLS LAST, pos) AS integer) AS rank, '{mode}' AS mode
FROM (SELECT *, {_UNSCORABLE} AS total FROM weighed) WHERE {where}"""


ORACLES: dict[str, str] = {
    "validate_requests": with_ctes(
        ["requests"],
        """
SELECT o_orderkey AS msg_id, CASE WHEN n = 0 THEN 'no providers' WHEN n = 1 OR o_orderkey % 5 = 4 THEN NULL
  WHEN o_orderkey % 5 = 0 THEN 'unsupported version: 9.9' WHEN o_orderkey % 5 = 1 THEN 'invalid keys: hobby'
  WHEN o_orderkey % 5 = 2 THEN 'missing keys: template_name' ELSE 'missing keys: exact_flavors' END AS reason
FROM (SELECT o.o_orderkey, count(r.msg_id) AS n FROM orders o LEFT JOIN requests r ON r.msg_id = o.o_orderkey GROUP BY ALL)""",
    ),
    "lone_candidate_echo": with_ctes(
        ["requests"],
        f"""
SELECT cast(msg_id AS varchar) AS uuid, concat('{{"ranked_providers":[{{', CASE WHEN msg_id % 3 = 0 THEN '' ELSE '"classification":-1.0,' END,
  '"regression":-1.0,"resource_exactness":', cast(exact_flavors / 4 AS varchar), ',', substr({LONE_ENTRY.format(S="varchar")}, 2),
  '],"uuid":"', cast(msg_id AS varchar), '"}}') AS value
FROM requests WHERE pos = 1""",
    ),
    "ingest_stream": with_ctes(
        ["topic_messages"],
        f"""
SELECT json_extract_string(value, '$.uuid') AS uuid, cast(json_extract_string(value, '$.n_failures') AS integer) AS n_failures,
  cast(NULL AS varchar) AS reason FROM topic_messages
WHERE json_extract_string(value, '$.msg_version') = '1.1.0' AND len(list_filter(json_keys(value), lambda k: k NOT IN ('msg_version', {_ALLOWED}))) = 0
UNION ALL SELECT json_extract_string(value, '$.uuid'), NULL, CASE
  WHEN json_extract_string(value, '$.msg_version') <> '1.1.0' THEN concat('unsupported version: ', json_extract_string(value, '$.msg_version'))
  ELSE 'invalid keys: colour,shape' END FROM topic_messages
WHERE json_extract_string(value, '$.msg_version') <> '1.1.0' OR len(list_filter(json_keys(value), lambda k: k NOT IN ('msg_version', {_ALLOWED}))) > 0""",
    ),
    "split_members": with_ctes(
        ["derived"],
        f"""
SELECT uuid, CASE WHEN row_number() OVER (ORDER BY {HASH}) <= ceil(count(*) OVER () * 0.2E0)
  THEN 'test' ELSE 'train' END AS part FROM derived""",
    ),
    "fold_members": with_ctes(
        ["derived"],
        f"""
, placed AS (
  SELECT uuid, status, row_number() OVER (PARTITION BY status ORDER BY {HASH}) AS k FROM derived),
counts AS (SELECT status, count(*) AS n, sum(count(*)) OVER (ORDER BY status) AS stop FROM derived GROUP BY status),
sizes AS (
  SELECT status, i, (stop - i + 4) // 5 - (stop - n - i + 4) // 5 AS size
  FROM counts, range(5) AS folds(i)),
ends AS (SELECT status, i, sum(size) OVER (PARTITION BY status ORDER BY i) AS reached FROM sizes)
SELECT uuid, cast(min(i) AS integer) AS fold FROM placed JOIN ends USING (status) WHERE k <= reached GROUP BY uuid, status, k""",
    ),
    "rank_unscorable": with_ctes(
        ["weighed"],
        _unscorable("kept", f"total >= {THRESHOLD}E0") + "\nUNION ALL" + _unscorable("all", "true"),
    ),
    "answers_round_trip": with_ctes(
        ["processed"],
        """
SELECT o.o_orderkey AS msg_id FROM orders o
LEFT JOIN (SELECT uuid, count(*) AS answered FROM processed GROUP BY uuid) p ON p.uuid = cast(o.o_orderkey AS varchar)
WHERE p.answered IS NULL""",
    ),
    "history_files": with_ctes(
        ["deployments"],
        """
, texts AS (
  SELECT uuid, template_name, concat('said "no",', chr(10), template_name) AS status_reason,
    vcpus_quota, vcpus_usage, cast(n_failures AS integer) AS n_failures FROM deployments)
SELECT 'csv' AS kind, * FROM texts
UNION ALL SELECT 'csv', uuid, template_name, NULL, NULL, NULL, n_failures FROM texts
UNION ALL SELECT 'json', * FROM texts UNION ALL SELECT 'array', * FROM texts UNION ALL SELECT 'labels', * FROM texts""",
    ),
    "clean_history": with_ctes(
        ["cleaned"],
        """
SELECT uuid, provider_name, region_name, template_name, cast(status AS integer) AS status,
  epoch_us(timestamp) AS ts_us, deployment_time, completion_time_s,
  cast(n_failures AS integer) AS n_failures FROM cleaned""",
    ),
    "derived_properties": with_ctes(
        ["derived"],
        f"""
SELECT uuid, provider, {", ".join(RESOURCE_DIFFS)}, gpu, cast(complexity AS integer) AS complexity
FROM derived""",
    ),
    "rolling_history_30d": with_ctes(["rolled"], f"SELECT uuid, {_STATS} FROM rolled"),
    "rolling_history_skew_halo": with_ctes(["rolled"], f"SELECT uuid, {_STATS} FROM rolled"),
    "rolling_history_events_7d": with_ctes(
        ["events_history"],
        f"""
SELECT uuid, {_stats("w")} FROM events_history
WINDOW w AS (PARTITION BY provider, template_name ORDER BY timestamp {_frame(7)})""",
    ),
    "latest_state": with_ctes(
        ["state"], f"SELECT provider, template_name, epoch_us(timestamp) AS ts_us, {_STATS} FROM state"
    ),
    "resource_exactness": with_ctes(
        ["described"], "SELECT msg_id, cast(pos AS integer) AS pos, resource_exactness FROM described"
    ),
    "merge_repeats": with_ctes(
        ["merged"],
        """
SELECT msg_id, provider, cast(pos AS integer) AS pos, n_instances_requ, vcpus_usage, resource_exactness
FROM merged""",
    ),
    "enrich_requests": with_ctes(
        ["enriched"], f"SELECT msg_id, provider, template_name, cast(pos AS integer) AS pos, {_STATS} FROM enriched"
    ),
    "duration_goodness": with_ctes(
        ["scored"], "SELECT msg_id, provider, p_success AS classification, goodness AS regression FROM scored"
    ),
    "void_messages": with_ctes(
        ["scored"],
        """
SELECT msg_id, provider,
  CASE WHEN max(CASE WHEN n_instances_requ = 6 THEN 1 ELSE 0 END) OVER (PARTITION BY msg_id) = 1
       THEN -1.0E0 ELSE p_success END AS classification
FROM scored""",
    ),
    "rank_exact_precedence": _ranking(_BY_EXACTNESS),
    "rank_by_score": _ranking(_BY_SCORE),
    "rank_filtered": _ranking(_BY_EXACTNESS, f"classification + regression >= {THRESHOLD}E0"),
    "ranked_messages": with_ctes(
        ["weighed"],
        f"""
, answers AS (
  SELECT msg_id, cast(count(*) FILTER (classification + regression >= {THRESHOLD}E0) AS integer) AS n_ranked,
    coalesce(string_agg(provider, '>' ORDER BY {_BY_EXACTNESS})
             FILTER (classification + regression >= {THRESHOLD}E0), '') AS ranking,
    round(coalesce(sum(classification + regression)
          FILTER (classification + regression >= {THRESHOLD}E0), 0.0E0), 6) AS total
  FROM weighed GROUP BY msg_id
  UNION ALL
  SELECT msg_id, 1, provider, -2.0E0 FROM described WHERE n_candidates = 1)
SELECT msg_id, cast(msg_id AS varchar) AS uuid, n_ranked, ranking, total FROM answers""",
    ),
    "route_by_provider_count": with_ctes(
        ["requests"],
        """
SELECT o.o_orderkey AS msg_id, cast(count(r.msg_id) AS integer) AS n_providers,
  CASE WHEN count(r.msg_id) = 0 THEN 'none' WHEN count(r.msg_id) = 1 THEN 'single' ELSE 'scored' END AS route
FROM orders o LEFT JOIN requests r ON r.msg_id = o.o_orderkey GROUP BY o.o_orderkey""",
    ),
    "skip_processed": with_ctes(
        ["processed"],
        "SELECT o_orderkey AS msg_id FROM orders WHERE cast(o_orderkey AS varchar) NOT IN (SELECT uuid FROM processed)",
    ),
    "skip_processed_repeats": with_ctes(
        ["processed"],
        f"""
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey FROM lineitem l
LEFT JOIN (SELECT uuid, count(*) AS answered FROM processed GROUP BY uuid) p
  ON p.uuid = cast(l.l_orderkey AS varchar)
QUALIFY row_number() OVER (PARTITION BY l.l_orderkey ORDER BY {_ANSWERED_ORDER}) > coalesce(max(p.answered)
  OVER (PARTITION BY l.l_orderkey), 0)""",
    ),
    "validate_messages": with_ctes(
        ["topic_messages"],
        f"""
SELECT uuid, CASE
  WHEN version <> '1.1.0' THEN concat('unsupported version: ', version)
  WHEN len(bad) > 0 THEN concat('invalid keys: ', array_to_string(list_sort(bad), ',')) END AS reason
FROM (SELECT uuid, json_extract_string(value, '$.msg_version') AS version,
        list_filter(json_keys(value), lambda k: k NOT IN ('msg_version', {_ALLOWED})) AS bad
      FROM topic_messages)""",
    ),
    "history_to_json": with_ctes(
        ["deployments"], f"SELECT uuid, cast(json_object({_JSON_OBJECT}) AS varchar) AS value FROM deployments"
    ),
    "history_from_messages": with_ctes(
        ["derived"], "SELECT uuid, provider, template_name, deployment_time, cpu_diff FROM derived"
    ),
    "quantile_bounds": with_ctes(
        ["derived"],
        f"""
SELECT feature, round(q1, 6) AS q1, round(q3, 6) AS q3, round(q1 - 1.5 * (q3 - q1), 6) AS lower_fence,
  round(q3 + 1.5 * (q3 - q1), 6) AS upper_fence FROM ({_quantiles(FENCED, "derived")})""",
    ),
    "iqr_filter": with_ctes(
        ["derived"], f", q AS ({_quantiles(FENCED, 'derived')}) SELECT uuid FROM derived WHERE {_INSIDE}"
    ),
    "robust_scale": with_ctes(
        ["derived"], f", q AS ({_quantiles(SCALED, 'derived')}) SELECT uuid, {_SCALING} FROM derived"
    ),
    "split_sizes": with_ctes(
        ["derived"],
        """
SELECT 'test' AS part, cast(ceil(count(*) * 0.2E0) AS bigint) AS n FROM derived
UNION ALL SELECT 'train', count(*) - cast(ceil(count(*) * 0.2E0) AS bigint) FROM derived""",
    ),
    "fold_sizes": with_ctes(
        ["derived"],
        """
SELECT cast(status AS integer) AS status, cast(fold AS integer) AS fold, count(*) AS n
FROM (SELECT status, (row_number() OVER (ORDER BY status) - 1) % 5 AS fold FROM derived) GROUP BY ALL""",
    ),
    "classification_metrics": with_ctes(
        ["predictions"],
        f"""
, c AS ({_COUNTS})
SELECT round({_share("tp + tn", "(tp + fp + fn + tn)")}, 6) AS accuracy,
  round({_share("tp", "(tp + fp)")}, 6) AS precision, round({_share("tp", "(tp + fn)")}, 6) AS recall,
  round({_share("2 * tp", "(2 * tp + fp + fn)")}, 6) AS f1 FROM c""",
    ),
    "roc_auc": with_ctes(
        ["predictions"],
        """
, r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0E0 AS place
        FROM predictions)
SELECT round((sum(place) FILTER (y = 1) - n1 * (n1 + 1) / 2.0E0) / (n1 * n0), 6) AS auc
FROM r, (SELECT count(*) FILTER (y = 1) * 1.0E0 AS n1, count(*) FILTER (y = 0) * 1.0E0 AS n0 FROM r)
GROUP BY n1, n0""",
    ),
    "confusion_matrix": with_ctes(
        ["predictions"],
        """
SELECT cast(a.v AS integer) AS y, cast(b.v AS integer) AS y_hat, count(p.y) AS n
FROM (VALUES (0), (1)) a(v) CROSS JOIN (VALUES (0), (1)) b(v)
LEFT JOIN predictions p ON p.y = a.v AND p.y_hat = b.v GROUP BY ALL""",
    ),
    "class_report": with_ctes(
        ["predictions"],
        f"""
, c AS ({_COUNTS}), k AS ({_class_rows("tn", "fn", "fp", "0")} UNION ALL {_class_rows("tp", "fp", "fn", "1")}),
r AS (SELECT * FROM k
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM k
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
    sum(f1 * support) / sum(support), sum(support) FROM k)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
  cast(support AS bigint) AS support FROM r""",
    ),
    "regression_metrics": with_ctes(
        ["durations"],
        """
SELECT round(avg((y - y_hat) * (y - y_hat)), 6) AS mse, round(sqrt(avg((y - y_hat) * (y - y_hat))), 6) AS rmse,
  round(avg(abs(y - y_hat)), 6) AS mae, round(1 - avg((y - y_hat) * (y - y_hat)) / var_pop(y), 6) AS r2
FROM durations""",
    ),
    "dataset_span": with_ctes(
        ["cleaned"], "SELECT epoch_us(min(timestamp)) AS start_us, epoch_us(max(timestamp)) AS end_us FROM cleaned"
    ),
    "registry_latest": """
SELECT o_orderpriority AS name, cast(max(o_custkey) AS integer) AS version, count(*) AS versions
FROM orders GROUP BY o_orderpriority""",
    "stream_rank": with_ctes(
        ["weighed", "processed"],
        f"""
, answers AS (
  SELECT msg_id, cast(count(*) AS integer) AS n_ranked,
    string_agg(provider, '>' ORDER BY {_BY_EXACTNESS}) AS ranking FROM weighed GROUP BY msg_id
  UNION ALL
  SELECT msg_id, 1, provider FROM described WHERE n_candidates = 1)
SELECT cast(msg_id AS varchar) AS uuid, n_ranked, ranking FROM answers
WHERE cast(msg_id AS varchar) NOT IN (SELECT uuid FROM processed)""",
    ),
}

ORACLES["latest_state_incremental"] = ORACLES["latest_state"]
ORACLES["dead_letters"] = f"SELECT msg_id, reason FROM ({ORACLES['validate_requests']}) WHERE reason IS NOT NULL"
ORACLES["stream_rank_batches"] = with_ctes(
    ["weighed", "processed"],
    f"""
, asked AS (SELECT o_orderkey AS msg_id, 0 AS batch FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 1 FROM orders),
cancelled AS (SELECT uuid, count(*) AS answered FROM processed GROUP BY uuid),
still_open AS (
  SELECT msg_id, batch FROM asked LEFT JOIN cancelled ON uuid = cast(msg_id AS varchar)
  QUALIFY row_number() OVER (PARTITION BY msg_id ORDER BY batch) > coalesce(max(answered) OVER (PARTITION BY msg_id), 0)),
answers AS (
  SELECT msg_id, 0 AS batch, cast(count(*) AS integer) AS n_ranked, string_agg(provider, '>' ORDER BY resource_exactness DESC, pos) AS ranking
  FROM weighed GROUP BY msg_id
  UNION ALL SELECT msg_id, 1, cast(count(*) AS integer), string_agg(provider, '>' ORDER BY {_BY_EXACTNESS}) FROM weighed GROUP BY msg_id
  UNION ALL SELECT msg_id, batch, 1, provider FROM described, (SELECT unnest([0, 1]) AS batch) WHERE n_candidates = 1)
SELECT cast(msg_id AS varchar) AS uuid, batch, n_ranked, ranking FROM answers JOIN still_open USING (msg_id, batch)""",
)
ORACLES["topic_dump"] = with_ctes(
    ["topic_messages"],
    "SELECT value, 0 AS partition, cast(json_extract_string(value, '$.uuid') AS bigint) AS offset FROM topic_messages",
)
ORACLES["published_requests"] = with_ctes(
    ["requests"],
    "SELECT uuid, template_name, cast(pos AS integer) AS pos, provider_name, region_name, n_instances_requ, vcpus_usage FROM requests",
)
