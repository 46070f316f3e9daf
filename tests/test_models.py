"""Learners, importances, registry and the training job."""

import math
import uuid
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from moorage.operators import importance as importances
from moorage.operators import models
from moorage.operators.closed_form import CLOSED_FORMS, moments
from moorage.operators.importance import coalitions, importance, own_importance, shapley_importance, shapley_values
from moorage.operators.registry import ModelInfo, Registry, _made, newest_versions
from moorage.plans.inference import ModelChoice, history_state, rank_messages, registered_scorer
from moorage.plans.training import TrainSpec, train
from moorage.operators.sampling import with_folds
from moorage.operators.scaling import fit_scaler, scaled_name, scaler_stage
from moorage.settle import settle, shared_folder
from tests.test_ranking import candidate, requests


@pytest.fixture(scope="module")
def rows(spark):
    x = F.col("id")
    return (
        spark.range(240)
        .select(
            ((x * 37) % 101 / 10).alias("a"),
            ((x * 53) % 97 / 10).alias("b"),
            ((x * 11) % 13 / 1.0).alias("c"),
        )
        .withColumn("y", (F.col("a") + F.col("b") / 4 > 6).cast("int"))
        .withColumn("t", 3 * F.col("a") - 2 * F.col("b") + 7)
    )


FEATURES = ["a", "b", "c"]


def fit(rows, name, kind, label, **params):
    return models.fit(rows, name=name, params=params, kind=kind, features=FEATURES, label=label)


@pytest.mark.parametrize(
    "name, params",
    [
        ("RandomForestClassifier", {"n_estimators": 5, "max_depth": 4, "random_state": 1}),
        ("DecisionTreeClassifier", {"max_depth": None, "min_samples_leaf": 2}),
        ("GradientBoostingClassifier", {"n_estimators": 5}),
        ("LogisticRegression", {"C": 10.0}),
        ("GaussianNB", {}),
        ("MultinomialNB", {"alpha": 0.5}),
        ("MLPClassifier", {"hidden_layer_sizes": [4], "max_iter": 30}),
    ],
)
def test_classifiers(rows, name, params):
    fitted = fit(rows, name, models.CLASSIFIER, "y", **params)
    values = models.train_and_test_metrics(fitted, rows, rows)
    names = ["accuracy", "auc", "f1", "precision", "recall"]
    assert sorted(values) == sorted(f"{m}_{p}" for m in names for p in ("train", "test"))
    assert all(0 <= v <= 1 for v in values.values())


@pytest.mark.parametrize(
    "name, params",
    [
        ("RandomForestRegressor", {"n_estimators": 5, "max_depth": 5}),
        ("DecisionTreeRegressor", {"max_depth": 5}),
        ("GradientBoostingRegressor", {"n_estimators": 5}),
        ("LinearRegression", {}),
        ("Ridge", {"alpha": 0.1}),
        ("Lasso", {"alpha": 0.1}),
        ("ElasticNet", {"alpha": 0.1, "l1_ratio": 0.3}),
        ("TweedieRegressor", {"power": 0.0}),
    ],
)
def test_regressors(rows, name, params):
    fitted = fit(rows, name, models.REGRESSOR, "t", **params)
    values = models.evaluate(fitted, rows)
    assert sorted(values) == ["mae", "mse", "r2", "rmse"] and values["r2"] > 0


def test_unusable_names_and_parameters(rows):
    with pytest.raises(ValueError, match="not found"):
        models.learner("NoSuchModel", models.CLASSIFIER)
    with pytest.raises(TypeError, match="not a regressor"):
        models.learner("LogisticRegression", models.REGRESSOR)
    with pytest.raises(ValueError, match="probability"):
        models.learner("LinearSVC", models.CLASSIFIER)
    with pytest.raises(ValueError, match="no parameter 'colour'"):
        fit(rows, "LogisticRegression", models.CLASSIFIER, "y", colour=1)


def test_customary_defaults():
    stage = models.estimator("RandomForestClassifier", {}, kind=models.CLASSIFIER, label="y", rows=9, width=3)
    assert (stage.getNumTrees(), stage.getMaxDepth()) == (100, 30)
    stage = models.estimator("LogisticRegression", {"C": 0.5}, kind=models.CLASSIFIER, label="y", rows=100, width=3)
    assert stage.getRegParam() == pytest.approx(0.02)


def test_the_better_model_wins(rows):
    listed = {"DecisionTreeRegressor": {"max_depth": 1}, "LinearRegression": {}}
    how = {"kind": models.REGRESSOR, "features": FEATURES, "label": "t"}
    assert models.select_model(rows, listed, folds=3, scale=True, scale_inside_fold=True, **how) == "LinearRegression"
    assert models.select_model(rows, {"Lasso": {}}, **how) == "Lasso"


def test_equal_scores_keep_the_listed_order(spark):
    scores = [models.FoldScore(n, f, 0.5) for n in ("z", "a") for f in range(2)]
    summary = models.mean_scores(spark, scores)
    assert models.best_model(summary) == "z"
    assert summary.first()["std_score"] == 0.0


def test_own_importances(rows):
    forest = fit(rows, "DecisionTreeClassifier", models.CLASSIFIER, "y", max_depth=4)
    table = importance(forest, rows).collect()
    assert table[0]["feature"] == "a" and table[0]["importance"] >= table[1]["importance"]
    line = fit(rows, "LinearRegression", models.REGRESSOR, "t")
    assert own_importance(line) == pytest.approx([3.0, -2.0, 0.0], abs=1e-6)
    logistic = fit(rows, "LogisticRegression", models.CLASSIFIER, "y")
    assert (own_importance(logistic) >= 0).all()
    with pytest.raises(ValueError, match="training rows"):
        importance(line, rows.limit(0))


def test_shapley_values_of_a_line_have_a_closed_form(spark, rows):
    line = fit(rows, "LinearRegression", models.REGRESSOR, "t")
    values = shapley_values(line, rows, background_rows=10**6).collect()
    means = rows.agg(*[F.avg(c).alias(c) for c in FEATURES]).first()
    sampled = {tuple(r["x"]): r["phi"] for r in shapley_values(line, rows, background_rows=10**6, sets=coalitions(3, exact=False)).collect()}
    for r in values[:40]:
        expected = [w * (x - means[c]) for w, x, c in zip((3.0, -2.0, 0.0), r["x"], FEATURES)]
        assert r["phi"][0] == pytest.approx(expected, abs=1e-5) and len(r["phi"]) == 1
        # Any sample of coalitions is exact for an additive model.
        assert all(part == pytest.approx(expected, abs=1e-5) for part in sampled[tuple(r["x"])])


def test_a_line_is_explained_against_all_rows_without_fetching_them(rows, monkeypatch):
    line = fit(rows, "LinearRegression", models.REGRESSOR, "t")
    means = rows.agg(*[F.avg(c).alias(c) for c in FEATURES]).first()
    taken, collect = [], type(rows).collect
    monkeypatch.setattr(type(rows), "collect", lambda df: (found := collect(df), taken.append(len(found)))[0])
    for repeats, count in ((True, 240), (False, rows.select(*FEATURES).distinct().count())):
        values = shapley_values(line, rows, background=rows, sets=coalitions(3, exact=True), repeats=repeats).toLocalIterator()
        seen = [(r["x"], r["n"], r["phi"]) for r in values]
        assert max(taken) == 1  # a mean, not the background's rows
        assert len(seen) == count and sum(n for _, n, _ in seen) == 240
        for x, _, phi in seen:
            assert phi[0] == pytest.approx([w * (v - means[c]) for w, v, c in zip((3.0, -2.0, 0.0), x, FEATURES)], abs=1e-5)


def test_the_registered_importances_leave_no_row_out(spark, monkeypatch):
    from queries import registered

    asked = []
    monkeypatch.setattr(registered, "shapley_importance", lambda fitted, explained, **how: asked.append((explained, how)) or shapley_importance(fitted, explained, **how))
    registered.shapley_importance_query(spark, "/root/testdata/sf0.001").collect()
    (explained, how), = asked
    train, _ = registered._training_rows(spark, "/root/testdata/sf0.001", registered.DEFAULT_FEATURES, "deployment_time")
    assert explained.count() == how["background"].count() == train.count() > 4000
    assert len(how["sets"].members) == 2 ** len(registered.DEFAULT_FEATURES)


def test_sampled_coalitions_come_near_all(rows):
    bayes = fit(rows, "GaussianNB", models.CLASSIFIER, "y")
    exact = {r["feature"]: r for r in shapley_importance(bayes, rows, background_rows=10).collect()}
    sampled = {r["feature"]: r for r in shapley_importance(bayes, rows, background_rows=10, sets=coalitions(3, exact=False)).collect()}
    for c in FEATURES:
        assert exact[c]["standard_error"] is None and 0 <= sampled[c]["standard_error"] < 0.05
        assert sampled[c]["importance"] == pytest.approx(exact[c]["importance"], abs=0.02)
    many = coalitions(12)
    assert len(many.members) == 64 * 12 + 2 < 2**12 and (many.members[2::2] + many.members[3::2] == 2**12 - 1).all()


def test_costly_importances_need_a_number_of_rows(rows, monkeypatch):
    bayes = fit(rows, "GaussianNB", models.CLASSIFIER, "y")
    monkeypatch.setattr(importances, "MOST_ANSWERS", 10_000)
    with pytest.raises(ValueError, match="explained_rows"):
        importance(bayes, rows)
    assert importance(bayes, rows, explained_rows=5).count() == 3


def test_closed_forms_follow_from_merged_sums(rows):
    x = np.array([[r["a"], r["b"], r["c"], r["t"], r["y"]] for r in rows.collect()], float)
    line = fit(rows.withColumn("t", F.col("t") + F.col("c") * F.col("a")), "Ridge", models.REGRESSOR, "t", alpha=2.0).formula
    design, target = x[:, :3] - x[:, :3].mean(axis=0), x[:, 3] + x[:, 2] * x[:, 0]
    weights = np.linalg.solve(design.T @ design + 2 * np.eye(3), design.T @ (target - target.mean()))
    assert line.weights == pytest.approx(weights) and line.intercept == pytest.approx(target.mean() - x[:, :3].mean(axis=0) @ weights)
    through = fit(rows, "LinearRegression", models.REGRESSOR, "t", fit_intercept=False).formula
    assert through.intercept == 0 and through.weights == pytest.approx(np.linalg.lstsq(x[:, :3], x[:, 3], rcond=None)[0])

    bayes = fit(rows, "GaussianNB", models.CLASSIFIER, "y")
    log = np.zeros((len(x), 2))
    for k in (0, 1):
        own = x[x[:, 4] == k, :3]
        var = own.var(axis=0) + 1e-9 * x[:, :3].var(axis=0).max()
        log[:, k] = np.log(len(own) / len(x)) - 0.5 * (np.log(2 * np.pi * var) + (x[:, :3] - own.mean(axis=0)) ** 2 / var).sum(axis=1)
    expected = 1 / (1 + np.exp(log[:, 0] - log[:, 1]))
    got = {(r["a"], r["b"], r["c"]): r for r in bayes.predict(rows).collect()}
    for (a, b, c, *_), p in zip(x, expected):
        assert got[a, b, c]["probability"] == pytest.approx([1 - p, p], abs=1e-9) and got[a, b, c]["prediction"] == float(p > 0.5)
    parts = moments(rows, FEATURES, ["y"], crossed=True)
    whole = moments(rows, FEATURES, [], crossed=True)[()]
    merged = parts[0,] + parts[1,]
    assert merged.n == whole.n and merged.mean == pytest.approx(whole.mean) and merged.products == pytest.approx(whole.products)


def test_a_constant_feature_and_a_lone_class(spark, rows):
    flat = rows.withColumn("c", F.lit(5.0))
    assert fit(flat, "LinearRegression", models.REGRESSOR, "t").formula.weights == pytest.approx([3.0, -2.0, 0.0])
    lone = fit(rows.where("y = 0"), "GaussianNB", models.CLASSIFIER, "y").predict(rows)
    assert {tuple(r["probability"]) for r in lone.collect()} == {(1.0, 0.0)}
    with pytest.raises(ValueError, match="no value"):
        fit(rows.withColumn("a", F.lit(float("nan"))), "Ridge", models.REGRESSOR, "t")


@pytest.mark.parametrize("inside", [False, True])
def test_closed_folds_are_fitted_on_the_others(spark, rows, inside):
    how = {"kind": models.REGRESSOR, "features": FEATURES, "label": "t", "folds": 4}
    noisy = settle(rows.withColumn("t", F.col("t") + F.pmod(F.hash("a", "b"), F.lit(17))))
    scores = models.cross_validate(noisy, {"Ridge": {"alpha": 30.0}, "LinearRegression": {}}, scale=True, scale_inside_fold=inside, **how)
    folded = settle(with_folds(noisy.select(*FEATURES, "t"), 4, to="_fold"))
    for s in scores:
        learn, check = folded.where(F.col("_fold") != s.fold), folded.where(F.col("_fold") == s.fold)
        stages = None if inside else [scaler_stage(fit_scaler(noisy, FEATURES))]
        fitted = models.fit(stages[0].transform(learn) if stages else learn, name=s.name, params={"alpha": 30.0} if s.name == "Ridge" else {}, kind=models.REGRESSOR,
                            features=[scaled_name(c) for c in FEATURES] if stages else FEATURES, label="t", scale=inside)
        assert models.evaluate(fitted, stages[0].transform(check) if stages else check)["r2"] == pytest.approx(s.score)


FOREIGN = {"alpha": 5.0, "C": 3.0, "power": 2.0, "hidden_layer_sizes": [3], "l1_ratio": 0.5, "n_estimators": 3, "max_depth": 2, "var_smoothing": 1e-9, "penalty": "l1", "isotonic": True}
OWN = {
    "LogisticRegression": {"C", "penalty"},
    "GaussianNB": {"var_smoothing"},
    "MultinomialNB": {"alpha"},
    "MLPClassifier": {"hidden_layer_sizes"},
    "LinearRegression": set(),
    "Ridge": {"alpha"},
    "Lasso": {"alpha"},
    "ElasticNet": {"alpha", "l1_ratio"},
    "PoissonRegressor": {"alpha"},
    "GammaRegressor": {"alpha"},
    "TweedieRegressor": {"alpha", "power"},
    "IsotonicRegression": {"isotonic"},
    **dict.fromkeys(["RandomForestClassifier", "RandomForestRegressor", "GradientBoostingClassifier", "GradientBoostingRegressor"], {"n_estimators", "max_depth"}),
    **dict.fromkeys(["DecisionTreeClassifier", "DecisionTreeRegressor"], {"max_depth"}),
}


@pytest.mark.parametrize("name", models.known_names())
def test_parameters_of_other_learners_are_refused(spark, name):
    kind = models.CLASSIFIER if "Classifier" in name or "NB" in name or "Logistic" in name else models.REGRESSOR
    for given, value in FOREIGN.items():
        def made():
            if name in CLOSED_FORMS:
                return CLOSED_FORMS[name].check(name, {given: value})
            return models.estimator(name, {given: value}, kind=kind, label="y", rows=10, width=1)

        if given in OWN[name]:
            made()
        else:
            with pytest.raises(ValueError, match=given):
                made()


def test_shapley_values_add_up(rows):
    bayes = fit(rows, "GaussianNB", models.CLASSIFIER, "y")
    values = shapley_values(bayes, rows, background_rows=20).collect()
    assert sum(r["n"] for r in values) == rows.count()
    table = {r["feature"]: r["importance"] for r in importance(bayes, rows).collect()}
    assert sorted(table) == FEATURES and table["a"] > table["c"] >= 0
    first = shapley_importance(bayes, rows).first()
    assert first["feature"] == "a" and not math.isnan(first["importance"])


def test_newest_version_compares_numbers(spark):
    df = spark.createDataFrame([("m", "9"), ("m", "10"), ("n", "1")], "name string, version string")
    assert {r["name"]: r["version"] for r in newest_versions(df).collect()} == {"m": 10, "n": 1}


@pytest.fixture
def registry(spark):
    return Registry(spark, f"{shared_folder(spark)}/registry-{uuid.uuid4().hex}")


def test_registry(spark, rows, registry):
    fitted = fit(rows, "LinearRegression", models.REGRESSOR, "t")
    info = ModelInfo(datetime(2024, 1, 1), datetime(2024, 2, 1), [*FEATURES, "t"])
    assert info.features_number == 4
    with pytest.raises(ValueError, match="not found"):
        registry.load("LinearRegression")
    for expected in (1, 2, 3):
        version = registry.append(
            fitted, info=info, metrics={"r2_test": 1.0, "mae_test": None}, importances=importance(fitted, rows)
        )
        assert version == expected
        if expected == 1:
            assert registry.find("LinearRegression", "7")["version"] == 1
    assert registry.find("LinearRegression")["version"] == 3
    assert registry.find("LinearRegression", "2")["version"] == 2
    with pytest.raises(ValueError, match="version 7"):
        registry.find("LinearRegression", "7")
    assert registry.metrics().count() == 6 and registry.importances().count() == 9
    pipeline, features = registry.load("LinearRegression")
    assert features == FEATURES
    assert pipeline.transform(rows).count() == rows.count()


def test_writers_at_the_same_time_get_versions_of_their_own(spark, rows, registry):
    fitted = fit(rows, "Ridge", models.REGRESSOR, "t")
    info = ModelInfo(datetime(2024, 1, 1), datetime(2024, 2, 1), [*FEATURES, "t"])
    given = importance(fitted, rows)

    def write(k):
        return registry.append(fitted, info=info, metrics={"k": float(k)}, importances=given)

    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(write, range(8)))
    assert sorted(versions) == list(range(1, 9))
    stored = {r["version"]: r["value"] for r in registry.metrics().collect()}
    assert stored == {v: float(k) for k, v in enumerate(versions)}
    assert registry.find("Ridge")["version"] == 8 and registry.load("Ridge", "3")[1] == FEATURES
    # A job that died after its claim leaves a gap.
    assert registry._claim("Ridge") == 9 and write(9) == 10 and registry.find("Ridge")["version"] == 10


def test_a_file_is_made_once(spark):
    path = f"{shared_folder(spark)}/claim-{uuid.uuid4().hex}/1"
    with ThreadPoolExecutor(8) as pool:
        assert sum(pool.map(lambda _: _made(spark, path), range(32))) == 1


def test_train_and_rank_with_registered_models(spark, make_history, registry):
    history = make_history(
        *[
            {
                "submission_time": f"2024-01-{1 + i % 28:02d}",
                "provider_name": f"p{i % 3}",
                "vcpus_usage": float(i % 7),
                "status": "CREATE_FAILED" if i % 7 > 4 else "CREATE_COMPLETE",
                "completion_time_s": float(10 + i % 9),
            }
            for i in range(120)
        ]
    )
    features = ["cpu_diff", "avg_success_time", "failure_percentage", "gpu"]
    spec = TrainSpec(
        classifiers={"LogisticRegression": {}, "DecisionTreeClassifier": {"max_depth": 3}},
        regressors={"LinearRegression": {}},
        features=features,
        folds=2,
        scale=True,
        remove_outliers=True,
    )
    versions = train(spark, history, spec, registry)
    assert "LinearRegression" in versions and len(versions) == 2
    described = registry.models().collect()
    assert {tuple(r["features"]) for r in described} == {(*features, "status"), (*features, "deployment_time")}
    assert all(r["scaling"] and r["remove_outliers"] for r in described)
    assert {str(r["start_time"]) for r in described} == {"2024-01-01 00:00:00"}

    name = next(n for n in versions if n != "LinearRegression")
    scorer = registered_scorer(
        registry, classifier=ModelChoice(name), regressor=ModelChoice("LinearRegression", "1")
    )
    full = {"template_name": "tpl1", "vcpus_quota": 10.0, "vcpus_usage": 5.0, "vcpus_requ": 3.0}
    asked = requests(
        spark,
        [candidate(p, **{k: v for k, v in full.items() if k != "template_name"}) for p in ("p0", "p1")],
        [candidate("p0", vcpus_quota=1.0), candidate("p1", **full)],
    )
    state = history_state(history)
    answers = {r["uuid"]: r["ranked_providers"] for r in rank_messages(asked, state, scorer=scorer).collect()}
    assert all(0 <= p["classification"] <= 0.75 for p in answers["u0"])
    # A candidate with unknown usage cannot be scored, nor then its message.
    assert [p["classification"] for p in answers["u1"]] == [-0.75, -0.75]

    absent = registered_scorer(registry, classifier=ModelChoice("None"), regressor=ModelChoice("LinearRegression"))
    answers = {r["uuid"]: r["ranked_providers"] for r in rank_messages(asked, state, scorer=absent).collect()}
    assert {p["classification"] for p in answers["u0"]} == {-0.75}


def test_nothing_to_train_on(spark, make_history, registry):
    assert train(spark, make_history({"status": "?"}), TrainSpec(), registry) == {}


def test_unknown_features(spark, make_history, registry):
    with pytest.raises(ValueError, match="colour"):
        train(spark, make_history({}), TrainSpec(features=["colour"]), registry)


def test_moments_of_groups_some_sums_at_a_time(spark, monkeypatch):
    from moorage.operators import closed_form

    values = np.random.default_rng(1).normal(size=(200, 4)) + [0.0, 1e6, -3.0, 5.0]
    rows = [(i % 3 if i % 3 else None, *map(float, v)) for i, v in enumerate(values)]
    table = spark.createDataFrame(rows, "g int, a double, b double, c double, d double")
    monkeypatch.setattr(closed_form, "_SUMS", 3, raising=False)
    found = closed_form.moments(table, ["a", "b", "c", "d"], ["g"], crossed=True)
    assert set(found) == {(None,), (1,), (2,)}
    for (g,), m in found.items():
        own = values[(g or 0) :: 3]
        assert m.n == len(own)
        assert np.allclose(m.mean, own.mean(axis=0), rtol=1e-14)
        assert np.allclose(m.products, np.cov(own.T, bias=True) * len(own), rtol=1e-9, atol=1e-7)
    with pytest.raises(ValueError, match="no value"):
        closed_form.moments(table.withColumn("a", F.when(F.col("a") > 0, F.col("a"))), ["a", "b"], [], crossed=True)


def test_sums_of_training_rows_serve_models_of_several_parameters(spark):
    rows = spark.range(50).select((F.col("id") % 7).cast("double").alias("x"), (F.col("id") * 1.5).alias("y"))
    how = {"name": "Ridge", "kind": models.REGRESSOR, "features": ["x"], "label": "y", "scale": True}
    sums = models.training_sums(rows, **how)
    for alpha in (1.0, 10.0):
        own, shared = models.fit(rows, params={"alpha": alpha}, **how), models.fit(rows.limit(0), params={"alpha": alpha}, sums=sums, **how)
        assert own.formula.weights.tolist() == shared.formula.weights.tolist()
    with pytest.raises(TypeError, match="sums"):
        models.training_sums(rows, **how | {"name": "Lasso"})


def test_folds_are_settled_apart_and_stored_rows_once(spark, monkeypatch):
    from moorage.settle import settle

    rows = settle(spark.range(60).select(F.col("id").cast("string").alias("uuid"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") * 1.5).alias("y")))
    how = {"kind": models.REGRESSOR, "features": ["x"], "label": "y", "folds": 3, "by": "uuid", "scale": True}
    plain = models.cross_validate(rows, {"Ridge": {}}, **how)
    written = []
    monkeypatch.setattr(models, "settle", lambda df, **way: written.append(way) or settle(df, **way))
    assert models.cross_validate(rows, {"Ridge": {}}, stored=True, **how) == plain
    assert written[0] == {"partition_by": ["_fold"]}
