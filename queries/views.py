"""Views that give the given tables the columns of histories, requests, answers and predictions.

One SQL text serves both engines; only the name of the string type differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from moorage.sources.spread import deal_by_size, read_by_all, spread

TABLES = ["region", "nation", "supplier", "part", "orders", "lineitem", "events", "documents", "labels"]
# Tables that grow; the others are read as they are.
FACTS = ["lineitem", "events"]

_JOINS = """
JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation n ON s.s_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
JOIN part p ON l.l_partkey = p.p_partkey
"""

_RESOURCES = """
  100.0E0 + p.p_size AS vcpus_quota, l.l_quantity AS vcpus_usage,
  cast(l.l_linenumber AS double) AS vcpus_requ,
  400.0E0 AS ram_gb_quota, l.l_quantity * 4 AS ram_gb_usage,
  cast(l.l_linenumber * 2 AS double) AS ram_gb_requ,
  1000.0E0 AS storage_gb_quota, cast(p.p_size * 10 AS double) AS storage_gb_usage,
  l.l_quantity AS storage_gb_requ,
  60.0E0 AS n_instances_quota, cast(p.p_size AS double) AS n_instances_usage,
  cast(l.l_linenumber - 1 AS double) AS n_instances_requ,
  60.0E0 AS n_volumes_quota, l.l_quantity AS n_volumes_usage,
  cast(l.l_linenumber AS double) AS n_volumes_requ,
  10.0E0 AS floating_ips_quota, cast(p.p_size % 5 AS double) AS floating_ips_usage,
  cast(l.l_linenumber % 3 AS double) AS floating_ips_requ,
  cast(l.l_linenumber % 2 AS double) AS gpus_requ,
  least(cast(l.l_linenumber - 1 AS double), cast(p.p_size % 4 AS double)) AS exact_flavors,
  l.l_discount AS test_failure_perc_30d, l.l_tax AS test_failure_perc_7d,
  l.l_tax AS test_failure_perc_1d,
  1.0E0 + l.l_tax AS overbooking_ram, 1.0E0 + l.l_discount AS overbooking_cpu,
  l.l_quantity AS bandwidth_in, l.l_quantity * 2 AS bandwidth_out
"""

_TEMPLATES = """
CASE o.o_orderkey % 6 WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'STANDARD' WHEN 2 THEN 'PROMO'
  WHEN 3 THEN 'SMALL' WHEN 4 THEN 'MEDIUM' ELSE 'NO_SUCH_TEMPLATE' END
"""

VIEWS = {
    # One row per finished deployment.
    "deployments": f"""
SELECT concat(cast(l.l_orderkey AS {{S}}), '-', cast(l.l_linenumber AS {{S}}), '-',
              cast(l.l_partkey AS {{S}}), '-', cast(l.l_suppkey AS {{S}})) AS uuid,
  n.n_name AS provider_name, r.r_name AS region_name,
  p.p_type AS template_name, p.p_brand AS user_group, l.l_linestatus AS status_reason,
  CASE WHEN l.l_returnflag = 'R' THEN 'CREATE_FAILED'
       WHEN l.l_linenumber = 7 THEN 'CREATE_IN_PROGRESS'
       ELSE 'CREATE_COMPLETE' END AS status,
  CASE WHEN l.l_tax = 0.08 AND l.l_linenumber = 5 THEN 'not-a-date'
       ELSE cast(l.l_shipdate AS {{S}}) END AS submission_time,
  CASE WHEN l.l_returnflag = 'R' OR l.l_discount = 0 THEN 0.0E0
       ELSE cast(floor(l.l_extendedprice / 10) AS double) END AS completion_time_s,
  cast(floor(l.l_extendedprice / 5) AS double) AS tot_failure_time_s,
  CASE l.l_linenumber % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 4 END AS n_failures,
  {_RESOURCES}
FROM lineitem l {_JOINS}
""",
    # One row per (message, candidate).
    "requests": f"""
SELECT o.o_orderkey AS msg_id, cast(o.o_orderkey AS {{S}}) AS uuid,
  {_TEMPLATES} AS template_name,
  row_number() OVER (PARTITION BY o.o_orderkey
                     ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice,
                       l.l_shipdate, l.l_quantity, l.l_discount, l.l_tax) AS pos,
  n.n_name AS provider_name, r.r_name AS region_name,
  {_RESOURCES}
FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey {_JOINS}
""",
    # History messages as they stand in a topic, some of an unknown version or with a foreign field.
    "topic_messages": """
SELECT concat(cast(l_orderkey AS {S}), '-', cast(l_linenumber AS {S}), '-',
              cast(l_partkey AS {S}), '-', cast(l_suppkey AS {S})) AS uuid,
  concat('{"msg_version":"', CASE WHEN l_linenumber = 6 THEN '2.0.0' ELSE '1.1.0' END,
         '","uuid":"', cast(l_orderkey AS {S}), '","n_failures":', cast(l_linenumber AS {S}),
         CASE WHEN l_returnflag = 'R' THEN ',"shape":"round","colour":"red"' ELSE '' END, '}') AS value
FROM lineitem
""",
    # One row per past answer; multiples of 20 were answered twice.
    "processed": """
SELECT cast(o_orderkey AS {S}) AS uuid FROM orders WHERE o_orderkey % 10 = 0
UNION ALL SELECT cast(o_orderkey AS {S}) AS uuid FROM orders WHERE o_orderkey % 20 = 0
""",
    # Labels, scores and decisions without a model; the scores have ties.
    "predictions": """
SELECT l.toxic AS y, (d.n_chars % 100) / 100.0E0 AS score, l.quality AS y_hat
FROM labels l JOIN documents d ON l.doc_id = d.doc_id
""",
    "durations": "SELECT l_quantity AS y, l_linenumber * 8.0E0 AS y_hat FROM lineitem",
    # Many keys and times below the second.
    "events_history": """
SELECT cast(event_id AS {S}) AS uuid, cast(user_id AS {S}) AS provider,
  event_type AS template_name, ts AS timestamp,
  CASE WHEN event_type = 'error' OR value < 10 THEN 1 ELSE 0 END AS status,
  floor(value) * 1.0E0 AS deployment_time, floor(value) * 1.0E0 AS completion_time_s
FROM events
""",
}


def _of_lines(text: str) -> str:
    """``text`` with columns of orders and parts taken from the rows of lines that carry them."""
    return text.replace("o.o_", "l.o_").replace("p.p_", "l.p_")


#: What Spark runs for a view, where the text above would move more than it needs: requests join what lines refer to
#: first, then come together by order with the columns of the tables, and get the fields made of these behind the numbering.
_FOR_SPARK = {
    "requests": f"""
SELECT l.o_orderkey AS msg_id, cast(l.o_orderkey AS {{S}}) AS uuid,
  {_of_lines(_TEMPLATES)} AS template_name, l.pos, l.n_name AS provider_name, l.r_name AS region_name,
  {_of_lines(_RESOURCES)}
FROM (
  SELECT l.*, o.o_orderkey,
    row_number() OVER (PARTITION BY o.o_orderkey
                       ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice,
                         l.l_shipdate, l.l_quantity, l.l_discount, l.l_tax) AS pos
  FROM (SELECT l.*, n.n_name, r.r_name, p.p_size FROM lineitem l {_JOINS}) l JOIN orders o ON l.l_orderkey = o.o_orderkey) l
"""
}


def view_sql(name: str, string_type: str) -> str:
    return VIEWS[name].replace("{S}", string_type)


def load_tables(spark: SparkSession, sf_dir: str) -> None:
    deal_by_size(spark, [f"{sf_dir}/{name}.parquet" for name in TABLES])
    for name in TABLES:
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        # A table of one file is one split here, unless it is large and its row groups lie in several; one of many files is read as it is.
        alone = name in FACTS and len(table.inputFiles()) == 1 and not read_by_all(table)
        (spread(table) if alone else table).createOrReplaceTempView(name)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    load_tables(spark, sf_dir)
    return spark.sql(_FOR_SPARK.get(name, VIEWS[name]).replace("{S}", "STRING"))
