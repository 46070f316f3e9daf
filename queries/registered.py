"""The registered queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moorage.functions.clock import micros
from moorage.operators import metrics, models
from moorage.operators.answered import skip_answered
from moorage.operators.cleaning import clean, derive
from moorage.operators.enrich import enrich
from moorage.operators.importance import coalitions, importance, shapley_importance
from moorage.operators.latest import latest_state
from moorage.operators.outliers import iqr_fences, within_fences
from moorage.operators.quantiles import exact_quantiles
from moorage.operators.ranking import RankSpec, rank_candidates
from moorage.operators.registry import ModelInfo, Registry, newest_versions
from moorage.operators.requests import describe, merge_repeats, route
from moorage.operators.rolling import rolling_history
from moorage.operators.sampling import exact_split, with_folds
from moorage.operators.scaling import fit_scaler, robust_scale
from moorage.operators.scoring import any_missing, history_scores, model_scores, void_messages
from moorage.plans.inference import RankJob, rank_messages
from moorage.plans.training import feature_table, time_span
from moorage.schema import AS_SENT, CANDIDATE_FIELDS, DEFAULT_FEATURES, HISTORY_KEYS, HISTORY_SCHEMAS, HISTORY_STATS, RESOURCE_DIFFS
from moorage.settle import settle, settled_for_now, shared_folder, shuffles_removed
from moorage.sources.history import read_history_files
from moorage.sources.messages import AnswerSink, read_answers, write_answers
from moorage.sources.topics import answer_messages, dump, history_messages, parse_requests, read_history_messages, request_texts, struct_messages
from moorage.sources.validation import with_history_reason, with_request_reason
from moorage.streaming.ingest import append_history, current_state, ingest_history
from moorage.streaming.ranking import rank_stream
from queries.model_oracles import FOLDS, INDEPENDENT, RIDGE
from queries.oracles import COMPLEX, FENCED, LONE_ENTRY, SCALED, THRESHOLD
from queries.views import view

Query = Callable[[SparkSession, str], DataFrame]


def deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "deployments")


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(clean(deployments(spark, sf_dir)), complex_templates=COMPLEX)


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest history, from rows that are cleaned once, as it reads them twice."""
    with settled_for_now(spark) as kept:
        rows = derived(spark, sf_dir).select(*HISTORY_KEYS, "timestamp", "status", "deployment_time", "completion_time_s")
        return kept(latest_state(settle(rows)))


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "requests").withColumn("pos", F.col("pos").cast("int"))
    return describe(rows, complex_templates=COMPLEX)


def comparable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Described candidates of messages with more than one, repeats merged."""
    candidates = F.count(F.lit(1)).over(Window.partitionBy("msg_id"))  # a message is one record
    rows = described(spark, sf_dir).withColumn("_candidates", candidates).where("_candidates > 1")
    return merge_repeats(rows.drop("_candidates"))


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich(comparable(spark, sf_dir), state(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history_scores(enriched(spark, sf_dir))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested requests, also those of orders without lines."""
    rows = view(spark, sf_dir, "requests")
    fields = [c for c in HISTORY_SCHEMAS["1.1.0"].fieldNames() if c in rows.columns]
    # In name order, as they are sent.
    fields = sorted(c for c in fields if c not in ("uuid", "template_name"))
    entry = F.struct("pos", F.struct(*fields).alias("p"))
    nested = rows.groupBy("msg_id").agg(
        F.first("template_name").alias("template_name"), F.array_sort(F.collect_list(entry)).alias("e")
    )
    orders = spark.table("orders").select(F.col("o_orderkey").alias("msg_id"))
    return orders.join(nested, "msg_id", "left").select(
        "msg_id",
        F.col("msg_id").cast("string").alias("uuid"),
        F.lit("1.1.0").alias("msg_version"),
        "template_name",
        F.coalesce(F.col("e.p"), F.array()).alias("providers"),
    )


def clean_history(spark, sf_dir):
    rows = clean(deployments(spark, sf_dir))
    return rows.select(
        "uuid",
        "provider_name",
        "region_name",
        "template_name",
        "status",
        micros(rows, "timestamp").alias("ts_us"),
        "deployment_time",
        "completion_time_s",
        "n_failures",
    )


def derived_properties(spark, sf_dir):
    return derived(spark, sf_dir).select("uuid", "provider", *RESOURCE_DIFFS, "gpu", "complexity")


def rolling_history_30d(spark, sf_dir):
    return rolling_history(derived(spark, sf_dir)).select("uuid", *HISTORY_STATS)


def rolling_history_skew_halo(spark, sf_dir):
    """The same in hourly slices, as a very hot key needs."""
    return rolling_history(derived(spark, sf_dir), grains=720).select("uuid", *HISTORY_STATS)


def rolling_history_events_7d(spark, sf_dir):
    rows = view(spark, sf_dir, "events_history")
    return rolling_history(rows, frame=timedelta(days=7), grains=28).select("uuid", *HISTORY_STATS)


def latest_state_query(spark, sf_dir):
    rows = latest_state(derived(spark, sf_dir))
    return rows.select("provider", "template_name", micros(rows, "timestamp").alias("ts_us"), *HISTORY_STATS)


def resource_exactness(spark, sf_dir):
    return described(spark, sf_dir).select("msg_id", "pos", "resource_exactness")


def merge_repeats_query(spark, sf_dir):
    return comparable(spark, sf_dir).select(
        "msg_id", "provider", "pos", "n_instances_requ", "vcpus_usage", "resource_exactness"
    )


def enrich_requests(spark, sf_dir):
    return enriched(spark, sf_dir).select("msg_id", "provider", "template_name", "pos", *HISTORY_STATS)


def duration_goodness(spark, sf_dir):
    return scored(spark, sf_dir).select("msg_id", "provider", "classification", "regression")


def void_messages_query(spark, sf_dir):
    """A candidate the model cannot score takes its whole message along."""
    broken = F.when(F.col("n_instances_requ") == 6, F.lit(float("nan"))).otherwise(F.col("cpu_diff"))
    rows = scored(spark, sf_dir).withColumn("cpu_diff", broken)
    voided = void_messages(rows, any_missing(["cpu_diff", "ram_diff"]), column="classification")
    return voided.select("msg_id", "provider", "classification")


def _ranked(spark, sf_dir, spec):
    columns = ["msg_id", "provider", "pos", "classification", "regression", "resource_exactness", "rank"]
    return rank_candidates(scored(spark, sf_dir), spec).select(*columns)


def rank_exact_precedence(spark, sf_dir):
    return _ranked(spark, sf_dir, RankSpec())


def rank_by_score(spark, sf_dir):
    return _ranked(spark, sf_dir, RankSpec(exact_first=False))


def rank_filtered(spark, sf_dir):
    return _ranked(spark, sf_dir, RankSpec(threshold=THRESHOLD))


def _ranking_text() -> Column:
    names = F.transform("ranked_providers", lambda p: F.concat(p["provider_name"], F.lit("-"), p["region_name"]))
    return F.array_join(names, ">").alias("ranking")


def ranked_messages(spark, sf_dir):
    """The whole inference path over nested messages."""
    job = RankJob(spec=RankSpec(threshold=THRESHOLD), complex_templates=COMPLEX)
    answers = rank_messages(messages(spark, sf_dir), state(spark, sf_dir), job=job, echo=["provider_name", "region_name"])
    total = F.aggregate(
        "ranked_providers", F.lit(0.0), lambda acc, p: acc + p["classification"] + p["regression"]
    )
    return answers.select(
        "msg_id",
        "uuid",
        F.size("ranked_providers").alias("n_ranked"),
        _ranking_text(),
        F.round(total, 6).alias("total"),
    )


def route_by_provider_count(spark, sf_dir):
    routed = route(messages(spark, sf_dir))
    return routed.select("msg_id", F.size("providers").alias("n_providers"), "route")


def skip_processed(spark, sf_dir):
    answers = view(spark, sf_dir, "processed")
    requests = spark.table("orders").select(
        F.col("o_orderkey").alias("msg_id"), F.col("o_orderkey").cast("string").alias("uuid")
    )
    return skip_answered(requests, answers, order=["msg_id"]).select("msg_id")


def skip_processed_repeats(spark, sf_dir):
    """Many requests per uuid: the first ones are cancelled, as many as there are answers."""
    answers = view(spark, sf_dir, "processed")
    place = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    requests = spark.table("lineitem").select("l_orderkey", *place)
    requests = requests.withColumn("uuid", F.col("l_orderkey").cast("string"))
    left = skip_answered(requests, answers, order=place, block=2)
    return left.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def validate_messages(spark, sf_dir):
    return with_history_reason(view(spark, sf_dir, "topic_messages")).select("uuid", "reason")


def _broken_requests(spark, sf_dir):
    """Requests with a defect each, by the order's number: version, foreign field, no template, no flavours."""
    rows = messages(spark, sf_dir).select("uuid", "msg_version", "template_name", "providers")
    text, number = F.col("value"), F.get_json_object("value", "$.uuid").cast("bigint")
    broken = (
        F.when(number % 5 == 0, F.replace(text, F.lit('"msg_version":"1.1.0"'), F.lit('"msg_version":"9.9"')))
        .when(number % 5 == 1, F.replace(text, F.lit('"gpus_requ":'), F.lit('"hobby":')))
        .when(number % 5 == 2, F.replace(text, F.lit('"template_name":'), F.lit('"no_template":')))
        .when(number % 5 == 3, F.regexp_replace(text, '"exact_flavors":[^,}]*,', ""))
        .otherwise(text)
    )
    return struct_messages(rows).select(number.alias("msg_id"), broken.alias("value"))


def validate_requests(spark, sf_dir):
    return with_request_reason(_broken_requests(spark, sf_dir), required=CANDIDATE_FIELDS).select("msg_id", "reason")


def dead_letters(spark, sf_dir):
    """What the request stream puts aside."""
    folder = f"{shared_folder(spark)}/refused-{uuid.uuid4().hex}"
    topic, source = _topic(_broken_requests(spark, sf_dir), F.col("msg_id"))
    no_answers = spark.createDataFrame([], "uuid string")
    known = state(spark, sf_dir)
    rank_stream(
        spark.readStream.schema(topic.schema).parquet(source),
        answers=no_answers,
        state=lambda _: known,
        sink=AnswerSink(path=f"{folder}/answers"),
        dead_letters=f"{folder}/refused",
        ledger=f"{folder}/ledger",
        checkpoint=f"{folder}/checkpoint",
        job=RankJob(complex_templates=COMPLEX),
        required=CANDIDATE_FIELDS,
    ).awaitTermination()
    return spark.read.parquet(f"{folder}/refused").select(F.col("offset").alias("msg_id"), "reason")


def lone_candidate_echo(spark, sf_dir):
    """A request's only candidate goes out as its text, with the scores it has not got."""
    view(spark, sf_dir, "requests").createOrReplaceTempView("all_requests")
    entries = spark.sql(f"SELECT msg_id, {LONE_ENTRY.format(S='STRING')} AS entry FROM all_requests WHERE pos = 1")
    text = F.concat(F.lit('{"uuid":"'), F.col("msg_id").cast("string"), F.lit('","msg_version":"1.1.0","template_name":"t","providers":['), "entry", F.lit("]}"))
    requests = parse_requests(entries.select("msg_id", text.alias("value")))
    no_state = state(spark, sf_dir).limit(0)
    answers = rank_messages(requests, no_state, job=RankJob(complex_templates=COMPLEX), echo=[AS_SENT])
    return answer_messages(answers).select(F.get_json_object("value", "$.uuid").alias("uuid"), "value")


def ingest_stream(spark, sf_dir):
    """History messages through the ingestion stream: stored rows and refused messages."""
    folder = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    topic, source = _topic(view(spark, sf_dir, "topic_messages"), F.lit(0))
    ingest_history(
        spark.readStream.schema(topic.schema).option("maxFilesPerTrigger", 4).parquet(source),
        table=f"{folder}/history",
        dead_letters=f"{folder}/refused",
        checkpoint=f"{folder}/checkpoint",
    ).awaitTermination()
    stored = spark.read.parquet(f"{folder}/history").select("uuid", "n_failures", F.lit(None).cast("string").alias("reason"))
    refused = spark.read.parquet(f"{folder}/refused")
    return stored.unionByName(refused.select(F.get_json_object("value", "$.uuid").alias("uuid"), F.lit(None).cast("int").alias("n_failures"), "reason"))


def latest_state_incremental(spark, sf_dir):
    """The newest state from daily partials of four batches that each hold rows of all days."""
    folder = f"{shared_folder(spark)}/batches-{uuid.uuid4().hex}"
    rows = settle(deployments(spark, sf_dir).withColumn("part", F.pmod(F.xxhash64("uuid"), F.lit(4))))
    for batch in range(4):
        append_history(rows.where(F.col("part") == batch).drop("part"), f"{folder}/history", batch, partials=f"{folder}/days")
    found = current_state(spark, f"{folder}/history", f"{folder}/days", complex_templates=COMPLEX)
    return found.select("provider", "template_name", micros(found, "timestamp").alias("ts_us"), *HISTORY_STATS)


def _topic(rows: DataFrame, offset: Column) -> tuple[DataFrame, str]:
    """``rows`` (value) settled in the shape of a topic, and their folder."""
    topic = settle(_shaped(rows, offset))
    return topic, topic.inputFiles()[0].rsplit("/", 1)[0]


def _shaped(rows: DataFrame, offset: Column) -> DataFrame:
    return rows.select(
        F.lit(None).cast("string").alias("key"),
        "value",
        F.lit("t").alias("topic"),
        F.lit(0).alias("partition"),
        offset.cast("bigint").alias("offset"),
        F.lit(0).cast("timestamp").alias("timestamp"),
    )


def history_to_json(spark, sf_dir):
    rows = deployments(spark, sf_dir)
    return history_messages(rows).select(F.get_json_object("value", "$.uuid").alias("uuid"), "value")


def history_from_messages(spark, sf_dir):
    """Round trip through topic messages."""
    rows = read_history_messages(history_messages(deployments(spark, sf_dir)))
    return derive(clean(rows)).select("uuid", "provider", "template_name", "deployment_time", "cpu_diff")


def quantile_bounds(spark, sf_dir):
    quantiles = exact_quantiles(settle(derived(spark, sf_dir).select(*FENCED)), FENCED, [0.25, 0.75])
    fences = [
        (c, round(q1, 6), round(q3, 6), round(q1 - 1.5 * (q3 - q1), 6), round(q3 + 1.5 * (q3 - q1), 6))
        for c, (q1, q3) in quantiles.items()
    ]
    return spark.createDataFrame(
        fences, "feature string, q1 double, q3 double, lower_fence double, upper_fence double"
    )


def iqr_filter_query(spark, sf_dir):
    rows = settle(derived(spark, sf_dir).select("uuid", *FENCED))
    return within_fences(rows, iqr_fences(rows, FENCED)).select("uuid")


def robust_scale_query(spark, sf_dir):
    rows = settle(derived(spark, sf_dir).select("uuid", *SCALED))
    scaled = robust_scale(rows, fit_scaler(rows, SCALED))
    return scaled.select("uuid", *[F.round(c, 6).alias(c) for c in SCALED])


def split_sizes(spark, sf_dir):
    rows = derived(spark, sf_dir).select("uuid", "timestamp", "status", "deployment_time", *RESOURCE_DIFFS)
    train, test = exact_split(rows, 0.2, by=["uuid"])
    counted = [
        rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        for name, rows in (("test", test), ("train", train))
    ]
    return counted[0].unionByName(counted[1])


def fold_sizes_query(spark, sf_dir):
    rows = derived(spark, sf_dir).select("uuid", "status")
    folded = with_folds(rows, 5, label="status")
    return folded.groupBy("status", "fold").agg(F.count(F.lit(1)).alias("n"))


def split_members(spark, sf_dir):
    train, test = exact_split(derived(spark, sf_dir).select("uuid"), 0.2, by=["uuid"])
    return test.withColumn("part", F.lit("test")).unionByName(train.withColumn("part", F.lit("train")))


def fold_members(spark, sf_dir):
    rows = derived(spark, sf_dir).select("uuid", "status")
    return with_folds(rows, 5, label="status", by=["uuid"]).select("uuid", F.col("fold").cast("int").alias("fold"))


def rank_unscorable(spark, sf_dir):
    """Candidates without a usable score pass no threshold and come last among the others."""
    n = F.col("n_instances_requ")
    broken = F.when(n == 6, F.lit(float("nan"))).when(n == 5, F.lit(None)).otherwise(F.col("regression"))
    rows = scored(spark, sf_dir).withColumn("regression", broken)
    kept = rank_candidates(rows, RankSpec(threshold=THRESHOLD)).select("msg_id", "provider", "rank", F.lit("kept").alias("mode"))
    every = rank_candidates(rows, RankSpec()).select("msg_id", "provider", "rank", F.lit("all").alias("mode"))
    return kept.unionByName(every)


def answers_round_trip(spark, sf_dir):
    """Answers written to a folder, read back, and cancelled against all requests."""
    folder = f"{shared_folder(spark)}/answers-{uuid.uuid4().hex}"
    entries = F.array(F.struct(F.lit("p").alias("provider_name"), F.lit("r").alias("region_name")))
    write_answers(view(spark, sf_dir, "processed").select("uuid", entries.alias("ranked_providers")), AnswerSink(path=folder))
    requests = spark.table("orders").select(
        F.col("o_orderkey").alias("msg_id"), F.col("o_orderkey").cast("string").alias("uuid")
    )
    return skip_answered(requests, read_answers(spark, folder), order=["msg_id"]).select("msg_id")


#: Rows of a JSON document that ``history_files`` writes.
_DOCUMENT_ROWS = 10_000


def _write_history_files(history: DataFrame, folder: str) -> None:
    rows = history.select("uuid", "template_name", "vcpus_quota", "vcpus_usage", "n_failures")
    rows = rows.withColumn("status_reason", F.concat(F.lit('said "no",\n'), "template_name"))
    # A uuid may come twice, a label not.
    labelled = settle(rows.withColumn("label", F.monotonically_increasing_id().cast("string")))
    rows = labelled.drop("label")
    rows.write.options(header=True, escape='"', compression="gzip").csv(f"{folder}/rows.csv")
    rows.select("uuid", "n_failures", "template_name").write.options(header=True, compression="gzip").mode("append").csv(f"{folder}/rows.csv")
    rows.write.option("compression", "gzip").json(f"{folder}/rows.json")
    # Documents of about one size, their number by the rows: the format has a document in one task.
    document_of = F.pmod(F.xxhash64("uuid"), F.lit(-(-rows.count() // _DOCUMENT_ROWS) or 1))
    # A row goes to its document once, with its label, whatever the document makes of its columns.
    held = F.collect_list(F.struct(*labelled.columns)).alias("rows")
    maps = [F.map_from_arrays(F.col("rows.label"), F.col(f"rows.{c}")).alias(c) for c in rows.columns]
    entries = F.transform("rows", lambda r: F.struct(*[r[c].alias(c) for c in rows.columns]))
    for name, document in (("array", entries), ("labels", F.struct(*maps))):
        texts = labelled.groupBy(document_of).agg(held).select(F.to_json(document).alias("value"))
        texts.write.options(maxRecordsPerFile=1, compression="gzip").text(f"{folder}/{name}.json")


def history_files(spark, sf_dir):
    """The history as CSV, as JSON lines, as a JSON array and as labelled values per column, with quotes and newlines in a text."""
    folder = f"{shared_folder(spark)}/history-{uuid.uuid4().hex}"
    with settled_for_now(spark), shuffles_removed(spark):
        _write_history_files(deployments(spark, sf_dir), folder)
    kinds = {"csv": "rows.csv", "json": "rows.json", "array": "array.json", "labels": "labels.json"}
    names = ["uuid", "template_name", "status_reason", "vcpus_quota", "vcpus_usage", "n_failures"]
    parts = [read_history_files(spark, f"{folder}/{name}").select(F.lit(kind).alias("kind"), *names) for kind, name in kinds.items()]
    return reduce(DataFrame.unionByName, parts)


def _rounded(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def classification_metrics(spark, sf_dir):
    values = metrics.classification_metrics(view(spark, sf_dir, "predictions"))
    return _rounded(values, ["accuracy", "precision", "recall", "f1"])


def roc_auc(spark, sf_dir):
    return _rounded(metrics.roc_auc(view(spark, sf_dir, "predictions")), ["auc"])


def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(view(spark, sf_dir, "predictions"))


def class_report(spark, sf_dir):
    return _rounded(metrics.class_report(view(spark, sf_dir, "predictions")), ["precision", "recall", "f1"])


def regression_metrics(spark, sf_dir):
    values = metrics.regression_metrics(view(spark, sf_dir, "durations"))
    return _rounded(values, ["mse", "rmse", "mae", "r2"])


def dataset_span(spark, sf_dir):
    span = time_span(clean(deployments(spark, sf_dir)))
    return span.select(micros(span, "start_time").alias("start_us"), micros(span, "end_time").alias("end_us"))


def registry_latest(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return newest_versions(
        orders.select(F.col("o_orderpriority").alias("name"), F.col("o_custkey").cast("string").alias("version"))
    )


def _training_rows(spark, sf_dir, features, *targets):
    """Settled rows of the training part and of the test part, with their ids."""
    table = feature_table(deployments(spark, sf_dir), complex_templates=COMPLEX)
    table = settle(table.select("uuid", *features, *targets))
    return exact_split(table, 0.2, by=["uuid"], stored=True)


def _metric_rows(spark, values: dict) -> DataFrame:
    """Six digits of each metric."""
    return spark.createDataFrame([(m, float(f"{v:.6g}")) for m, v in sorted(values.items())], "metric string, value double")


def _trained(spark, sf_dir, kind, name, target):
    train, test = _training_rows(spark, sf_dir, DEFAULT_FEATURES, target)
    fitted = models.fit(train, name=name, params={}, kind=kind, features=DEFAULT_FEATURES, label=target, scale=True)
    return _metric_rows(spark, models.train_and_test_metrics(fitted, train, test))


def train_classifier(spark, sf_dir):
    return _trained(spark, sf_dir, models.CLASSIFIER, "GaussianNB", "status")


def train_regressor(spark, sf_dir):
    return _trained(spark, sf_dir, models.REGRESSOR, "Ridge", "deployment_time")


def cross_validate(spark, sf_dir):
    train, _ = _training_rows(spark, sf_dir, DEFAULT_FEATURES, "status", "deployment_time")
    train = settle(train)
    how = {"folds": FOLDS, "by": "uuid", "scale": True, "stored": True}
    scores = models.cross_validate(train, {"GaussianNB": {}}, kind=models.CLASSIFIER, features=DEFAULT_FEATURES, label="status", **how)
    listed = {"LinearRegression": {}, "Ridge": {"alpha": RIDGE}}
    scores += models.cross_validate(train, listed, kind=models.REGRESSOR, features=INDEPENDENT, label="deployment_time", **how)
    return _rounded(models.mean_scores(spark, scores).select("name", "mean_score", "std_score"), ["mean_score", "std_score"])


def shapley_importance_query(spark, sf_dir):
    """All default features and all coalitions of them, all training rows explained, against all training rows."""
    train, _ = _training_rows(spark, sf_dir, DEFAULT_FEATURES, "deployment_time")
    fitted = models.fit(train, name="Ridge", params={"alpha": RIDGE}, kind=models.REGRESSOR, features=DEFAULT_FEATURES, label="deployment_time", scale=True)
    rows = shapley_importance(fitted, train, background=train, sets=coalitions(len(DEFAULT_FEATURES), exact=True)).collect()
    # The operator gives no error of sampling where nothing was sampled: it is nought.
    digits = [(r["feature"], float(f"{r['importance']:.6g}"), round(r["standard_error"] or 0.0, 6)) for r in rows]
    return spark.createDataFrame(digits, "feature string, importance double, standard_error double")


def score_and_rank_models(spark, sf_dir):
    """Two fitted models score all candidates, then the ranking."""
    train, _ = _training_rows(spark, sf_dir, DEFAULT_FEATURES, "status", "deployment_time")
    classifier = models.fit(train, name="GaussianNB", params={}, kind=models.CLASSIFIER, features=DEFAULT_FEATURES, label="status")
    regressor = models.fit(train, name="Ridge", params={"alpha": RIDGE}, kind=models.REGRESSOR, features=DEFAULT_FEATURES, label="deployment_time", scale=True)
    rows = model_scores(
        enriched(spark, sf_dir),
        classifier=classifier.pipeline,
        regressor=regressor.pipeline,
        class_features=DEFAULT_FEATURES,
        duration_features=DEFAULT_FEATURES,
    )
    ranked = rank_candidates(rows).select("msg_id", "provider", "classification", "regression", "rank")
    return _rounded(ranked, ["classification", "regression"])


def coefficient_importance(spark, sf_dir):
    """A line's own importances: its signed weights, largest first."""
    train, _ = _training_rows(spark, sf_dir, DEFAULT_FEATURES, "deployment_time")
    how = {"kind": models.REGRESSOR, "features": DEFAULT_FEATURES, "label": "deployment_time", "scale": True}
    fitted = models.fit(train, name="Ridge", params={"alpha": RIDGE}, **how)
    rows = importance(fitted, train).collect()
    digits = [(k, r["feature"], float(f"{r['importance']:.6g}")) for k, r in enumerate(rows, 1)]
    return spark.createDataFrame(digits, "place int, feature string, importance double")


def topic_dump(spark, sf_dir):
    return dump(_shaped(view(spark, sf_dir, "topic_messages"), F.get_json_object("value", "$.uuid"))).select("value", "partition", "offset")


def published_requests(spark, sf_dir):
    """Requests as they are sent to their topic, parsed from it, sent on, and parsed again."""
    sent = struct_messages(messages(spark, sf_dir).select("uuid", "msg_version", "template_name", "providers"))
    again = parse_requests(request_texts(parse_requests(sent)))
    entries = again.select("uuid", "template_name", F.posexplode("providers").alias("pos", "p"))
    fields = ["provider_name", "region_name", "n_instances_requ", "vcpus_usage"]
    return entries.select("uuid", "template_name", (F.col("pos") + 1).alias("pos"), *(F.col(f"p.{c}") for c in fields))


def registry_round_trip(spark, sf_dir):
    """A model stored twice, its newest version found among the versions, loaded, and its answers for the test part measured."""
    train, test = _training_rows(spark, sf_dir, DEFAULT_FEATURES, "deployment_time")
    how = {"kind": models.REGRESSOR, "features": DEFAULT_FEATURES, "label": "deployment_time", "scale": True}
    registry = Registry(spark, f"{shared_folder(spark)}/registry-{uuid.uuid4().hex}")
    info = ModelInfo(datetime(2024, 1, 1), datetime(2024, 2, 1), [*DEFAULT_FEATURES, "deployment_time"], scaling=True)
    none = spark.createDataFrame([], "feature string, importance double")
    sums = models.training_sums(train, name="Ridge", **how)
    for alpha in (100.0, RIDGE):
        fitted = models.fit(train, name="Ridge", params={"alpha": alpha}, sums=sums, **how)
        registry.append(fitted, info=info, metrics={"alpha": alpha}, importances=none)
    newest = newest_versions(registry.models())
    pipeline, _ = registry.load("Ridge", str(newest.first()["version"]))
    answered = pipeline.transform(test).select(F.col("deployment_time").alias("y"), F.col("prediction").alias("y_hat"))
    errors = metrics.regression_metrics(answered).first()
    values = [float(f"{errors[m]:.6g}") for m in ("mse", "mae", "r2")]
    stored = registry.metrics().join(newest.withColumnRenamed("versions", "stored_versions"), ["name", "version"])
    return stored.select("name", "version", "stored_versions", F.col("value").alias("alpha"), *(F.lit(v).alias(m) for m, v in zip(("mse", "mae", "r2"), values)))


def stream_rank_batches(spark, sf_dir):
    """Two micro-batches: even orders before there is any history, then all orders, with past answers cancelling the first requests."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    requests = struct_messages(messages(spark, sf_dir).select("uuid", "msg_version", "template_name", "providers"))
    number = F.get_json_object("value", "$.uuid").cast("bigint")
    sent = settle(requests.withColumn("number", number))
    known = state(spark, sf_dir)
    # The stream is started once for each part of the topic, so that a batch is a part however many files and tasks write it.
    parts = [(sent.where(F.col("number") % 2 == 0), F.col("number"), known.limit(0)), (sent, F.col("number") + 1_000_000_000, known)]
    for part, offset, history in parts:
        rows = _shaped(part, offset)
        rows.write.mode("append").option("compression", "zstd").parquet(f"{folder}/topic")
        rank_stream(
            spark.readStream.schema(rows.schema).parquet(f"{folder}/topic"),
            answers=view(spark, sf_dir, "processed"),
            state=lambda _, history=history: history,
            sink=AnswerSink(path=f"{folder}/answers"),
            dead_letters=f"{folder}/refused",
            ledger=f"{folder}/ledger",
            checkpoint=f"{folder}/checkpoint",
            job=RankJob(complex_templates=COMPLEX),
            required=CANDIDATE_FIELDS,
        ).awaitTermination()
    entry = "uuid string, ranked_providers array<struct<provider_name string, region_name string>>, batch_id int"
    answers = spark.read.schema(entry).json(f"{folder}/answers")
    return answers.select("uuid", F.col("batch_id").alias("batch"), F.size("ranked_providers").alias("n_ranked"), _ranking_text())


def stream_rank(spark, sf_dir):
    """The request stream over a topic-shaped folder of all requests, with past answers cancelled."""
    requests = struct_messages(messages(spark, sf_dir).select("uuid", "msg_version", "template_name", "providers"))
    topic, source = _topic(requests, F.get_json_object("value", "$.uuid"))
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    known = state(spark, sf_dir)
    rank_stream(
        spark.readStream.schema(topic.schema).parquet(source),
        answers=view(spark, sf_dir, "processed"),
        state=lambda _: known,
        sink=AnswerSink(path=f"{folder}/answers"),
        dead_letters=f"{folder}/refused",
        ledger=f"{folder}/ledger",
        checkpoint=f"{folder}/checkpoint",
        job=RankJob(complex_templates=COMPLEX),
        required=CANDIDATE_FIELDS,
    ).awaitTermination()
    entry = "uuid string, ranked_providers array<struct<provider_name string, region_name string>>"
    answers = spark.read.schema(entry).json(f"{folder}/answers")
    return answers.select("uuid", F.size("ranked_providers").alias("n_ranked"), _ranking_text())


QUERIES: dict[str, Query] = {
    "validate_requests": validate_requests,
    "dead_letters": dead_letters,
    "lone_candidate_echo": lone_candidate_echo,
    "ingest_stream": ingest_stream,
    "latest_state_incremental": latest_state_incremental,
    "split_members": split_members,
    "fold_members": fold_members,
    "rank_unscorable": rank_unscorable,
    "answers_round_trip": answers_round_trip,
    "history_files": history_files,
    "clean_history": clean_history,
    "derived_properties": derived_properties,
    "rolling_history_30d": rolling_history_30d,
    "rolling_history_skew_halo": rolling_history_skew_halo,
    "rolling_history_events_7d": rolling_history_events_7d,
    "latest_state": latest_state_query,
    "resource_exactness": resource_exactness,
    "merge_repeats": merge_repeats_query,
    "enrich_requests": enrich_requests,
    "duration_goodness": duration_goodness,
    "void_messages": void_messages_query,
    "rank_exact_precedence": rank_exact_precedence,
    "rank_by_score": rank_by_score,
    "rank_filtered": rank_filtered,
    "ranked_messages": ranked_messages,
    "route_by_provider_count": route_by_provider_count,
    "skip_processed": skip_processed,
    "skip_processed_repeats": skip_processed_repeats,
    "validate_messages": validate_messages,
    "history_to_json": history_to_json,
    "history_from_messages": history_from_messages,
    "quantile_bounds": quantile_bounds,
    "iqr_filter": iqr_filter_query,
    "robust_scale": robust_scale_query,
    "split_sizes": split_sizes,
    "fold_sizes": fold_sizes_query,
    "classification_metrics": classification_metrics,
    "roc_auc": roc_auc,
    "confusion_matrix": confusion_matrix,
    "class_report": class_report,
    "regression_metrics": regression_metrics,
    "dataset_span": dataset_span,
    "registry_latest": registry_latest,
    "train_classifier": train_classifier,
    "train_regressor": train_regressor,
    "cross_validate": cross_validate,
    "shapley_importance": shapley_importance_query,
    "score_and_rank_models": score_and_rank_models,
    "coefficient_importance": coefficient_importance,
    "topic_dump": topic_dump,
    "published_requests": published_requests,
    "registry_round_trip": registry_round_trip,
    "stream_rank": stream_rank,
    "stream_rank_batches": stream_rank_batches,
}
