"""Quantiles, outliers, scaling, splits and metrics."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from moorage.operators import metrics, quantiles, sampling
from moorage.operators.outliers import iqr_filter
from moorage.operators.quantiles import exact_quantiles
from moorage.operators.sampling import exact_split, fold_sizes, with_folds, with_parts
from moorage.operators.scaling import fit_scaler, robust_scale, scaled_name, scaler_stage
from moorage.settle import settle


def frame(spark, **columns):
    names = list(columns)
    rows = [tuple(float(v) for v in r) for r in zip(*columns.values())]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))


PROBABILITIES = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]


def draws(kind, n=4000):
    rng = random.Random(7)
    make = {
        "even": lambda: rng.random(),
        "heavy_tail": lambda: rng.choice([-1, 1]) * 10 ** rng.uniform(-200, 200),
        "one_value_mostly": lambda: 5.0 if rng.random() < 0.6 else rng.gauss(0, 1),
        "constant": lambda: 3.0,
    }[kind]
    return [make() for _ in range(n)]


@pytest.mark.parametrize("kind", ["even", "heavy_tail", "one_value_mostly", "constant"])
@pytest.mark.parametrize("in_one_task", [1, 50])
def test_searched_quantiles_are_exact(spark, kind, in_one_task):
    values = draws(kind)
    df = frame(spark, a=values, b=[-v for v in values])
    searched = exact_quantiles(df, ["a", "b"], PROBABILITIES, in_one_task=in_one_task)
    whole = exact_quantiles(df, ["a", "b"], PROBABILITIES)
    for name, column in (("a", np.array(values)), ("b", -np.array(values))):
        assert searched[name] == pytest.approx(np.quantile(column, PROBABILITIES).tolist(), rel=1e-12)
        assert whole[name] == searched[name]


@pytest.mark.parametrize("in_one_task", [100, 10**6])
def test_a_wrong_bracket_is_noticed(spark, monkeypatch, in_one_task):
    values = draws("even")
    found = quantiles._brackets

    def wrong(*args):
        slots, brackets, rows = found(*args)
        return slots, {s: (c, 0.3, 0.31 + k / 100) for k, (s, (c, _, _)) in enumerate(brackets.items())}, rows

    monkeypatch.setattr(quantiles, "_brackets", wrong)
    got = exact_quantiles(frame(spark, a=values), ["a"], PROBABILITIES, in_one_task=in_one_task)
    assert got["a"] == pytest.approx(np.quantile(values, PROBABILITIES).tolist(), rel=1e-12)


def test_brackets_of_many_rows_hold_their_ranks(spark):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.normal(0, 1, 30_000), np.full(12_345, 0.25), rng.pareto(0.4, 9_000)])
    df = settle(spark.createDataFrame([(float(v), float(-v)) for v in values], "a double, b double").repartition(7))
    slots, brackets, rows = quantiles._brackets(df, ["a", "b"], PROBABILITIES)
    assert rows == len(values) and set(quantiles._ordered_inside(df, slots, brackets)) == set(slots)
    got = exact_quantiles(df, ["a", "b"], PROBABILITIES)
    assert got["a"] == pytest.approx(np.quantile(values, PROBABILITIES).tolist(), rel=1e-12)
    assert got["b"] == pytest.approx(np.quantile(-values, PROBABILITIES).tolist(), rel=1e-12)


@pytest.mark.parametrize("in_one_task", [1, 1000])
def test_quantiles_with_infinities_and_overflowing_ranges(spark, in_one_task):
    inf, big = math.inf, 1.7e308
    values = [-inf, -big, *range(40), big, inf, inf]
    found = exact_quantiles(frame(spark, a=values), ["a"], [0.0, 0.02, 0.5, 0.9, 1.0], in_one_task=in_one_task)["a"]
    ordered = sorted(map(float, values))
    assert found[0] == -inf and found[-1] == inf and found[2] == ordered[22]
    assert found[1] == -inf and found[3] == pytest.approx(0.4 * ordered[39] + 0.6 * ordered[40])


def test_quantiles_skip_null_and_nan(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), None), (None, None), (3.0, None)], "a double, b double")
    found = exact_quantiles(df, ["a", "b"], [0.5])
    assert found == {"a": [2.0], "b": [None]}


def columns_of(seed, names, n):
    """Mostly close values, some far off on either side, some columns flat."""
    rng = random.Random(seed)
    return {c: [rng.choice([7.0, 7.5, 8.25]) if k % 3 else rng.gauss(40, 6) * rng.choice([1] * 12 + [-9, 25]) for _ in range(n)] for k, c in enumerate(names)}


@pytest.mark.parametrize("arguments", [{}, {"k": 0.5}, {"q1": 0.35, "q3": 0.65, "k": 2}, {"k": 1000}])
@pytest.mark.parametrize("seed, names, n", [(1, "u", 9), (2, "uv", 31), (3, "uvw", 64), (4, "uvwx", 200)])
def test_outliers(spark, seed, names, n, arguments):
    columns = columns_of(seed, names, n)
    kept = np.ones(n, bool)
    for values in map(np.array, columns.values()):
        low, high = np.quantile(values, [arguments.get("q1", 0.25), arguments.get("q3", 0.75)])
        reach = arguments.get("k", 1.5) * (high - low)
        kept &= (values >= low - reach) & (values <= high + reach)
    df = frame(spark, **columns)
    got = sorted(tuple(r) for r in iqr_filter(df, df.columns, **arguments).collect())
    assert got == sorted(r for r, k in zip(zip(*columns.values()), kept) if k)


def test_flat_columns_have_no_outliers_but_other_values(spark):
    df = frame(spark, a=[3, 3, 3, 3], b=[9, 9, 9, 9])
    assert iqr_filter(df, ["a", "b"]).count() == 4
    assert iqr_filter(frame(spark, a=[3, 3, 3, 3, 3, 4], b=[9, 9, 9, 9, 8, 9]), ["a", "b"]).count() == 4


def test_nan_and_null_are_no_outliers(spark):
    df = spark.createDataFrame([(float(i),) for i in range(9)] + [(None,), (float("nan"),), (99.0,)], "a double")
    assert iqr_filter(df, ["a"]).count() == 11


def test_rare_label_counts_as_outlier(spark):
    df = frame(spark, x=range(20), y=[0] * 17 + [1] * 3)
    assert iqr_filter(df, ["x", "y"]).where("y = 1").count() == 0


def test_scaler_and_its_stage_agree(spark):
    df = frame(spark, a=[1, 2, 3, 4], b=[5, 5, 5, 5])
    scaler = fit_scaler(df, ["a", "b"])
    assert scaler == {"a": (2.5, 1.5), "b": (5.0, 1.0)}
    by_column = [tuple(r) for r in robust_scale(df, scaler).orderBy("a").collect()]
    staged = scaler_stage(scaler).transform(df).orderBy("a")
    assert by_column == [tuple(r) for r in staged.select(scaled_name("a"), scaled_name("b")).collect()]
    assert by_column[0] == (-1.0, 0.0)


@pytest.mark.parametrize("share, test_rows", [(0.2, 20), (0.1, 10), (0.3, 30), (0.5, 50), (0.015, 2)])
def test_split_sizes_are_exact(spark, share, test_rows):
    df = spark.range(100)
    train, test = exact_split(df, share)
    assert (train.count(), test.count()) == (100 - test_rows, test_rows)
    assert train.join(test, "id").count() == 0 and train.union(test).distinct().count() == 100


def test_split_depends_on_rows_and_seed_only(spark):
    def part(df, **more):
        return {r["id"] for r in exact_split(df, 0.2, **more)[1].collect()}

    df = spark.range(300)
    assert part(df) == part(df.repartition(7).orderBy(F.col("id").desc()))
    assert part(df) != part(df, seed=1)


@pytest.mark.parametrize("rows", [0, 1])
def test_too_few_rows_to_split(spark, rows):
    with pytest.raises(ValueError):
        exact_split(spark.range(rows), 0.2)


def test_copies_are_dealt_exactly(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 700, 7).otherwise(F.col("id")).alias("v"))
    train, test = exact_split(df, 0.35)
    assert (train.count(), test.count()) == (650, 350)
    values = sorted(r["v"] for r in train.union(test).collect())
    assert values == sorted(r["v"] for r in df.collect())


def test_copies_only(spark):
    df = spark.range(50).select(F.lit("x").alias("v"))
    folded = with_folds(df, 4)
    assert sorted(r["count"] for r in folded.groupBy("fold").count().collect()) == [12, 12, 13, 13]


def test_empty_parts(spark):
    df = with_parts(spark.range(10), lambda totals: {0: [0, 4, 0, 6]})
    assert {r["part"]: r["count"] for r in df.groupBy("part").count().collect()} == {1: 4, 3: 6}


def test_folds_are_stratified(spark):
    df = spark.range(103).select("id", (F.col("id") % 5 == 0).cast("int").alias("y"))
    folded = with_folds(df, 4, label="y").groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("ones"))
    rows = folded.collect()
    assert len(rows) == 4 and {r["n"] for r in rows} == {25, 26} and {r["ones"] for r in rows} <= {5, 6}


def test_fold_sizes_balance_strata():
    sizes = fold_sizes({0: 7, 1: 6}, 4)
    assert sizes == {0: [2, 2, 2, 1], 1: [2, 1, 1, 2]}


def labelled(spark, rows):
    return spark.createDataFrame(rows, "y int, y_hat int, score double")


def test_classification_metrics(spark):
    df = labelled(spark, [(1, 1, 0.9), (1, 0, 0.4), (0, 1, 0.6), (0, 0, 0.1), (0, 0, 0.2)])
    row = metrics.classification_metrics(df).first()
    assert (row["accuracy"], row["precision"], row["recall"], row["f1"]) == (0.6, 0.5, 0.5, 0.5)
    cells = {(r["y"], r["y_hat"]): r["n"] for r in metrics.confusion_matrix(df).collect()}
    assert cells == {(0, 0): 2, (0, 1): 1, (1, 0): 1, (1, 1): 1}


def test_nothing_predicted_positive(spark):
    row = metrics.classification_metrics(labelled(spark, [(1, 0, 0.1), (0, 0, 0.1)])).first()
    assert (row["precision"], row["recall"], row["f1"]) == (0.0, 0.0, 0.0)


def test_class_report(spark):
    df = labelled(spark, [(1, 1, 0.9), (0, 0, 0.4), (0, 1, 0.6)])
    rows = {r["class"]: r for r in metrics.class_report(df).collect()}
    assert rows["0"]["recall"] == 0.5 and rows["1"]["precision"] == 0.5
    assert rows["macro avg"]["recall"] == 0.75
    assert rows["weighted avg"]["recall"] == pytest.approx(2 / 3) and rows["weighted avg"]["support"] == 3


@pytest.mark.parametrize("task_scores", [1, 9, 1_000_000])
def test_auc_with_ties(spark, task_scores):
    rng = random.Random(3)
    rows = [(rng.randint(0, 1), 0, rng.choice([0.1, 0.2, 0.5, rng.random()])) for _ in range(400)]
    pairs = [(a[2], b[2]) for a in rows for b in rows if a[0] == 1 and b[0] == 0]
    expected = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs) / len(pairs)
    assert metrics.roc_auc(labelled(spark, rows), task_scores=task_scores).first()[0] == pytest.approx(expected)


def test_auc_of_one_class(spark):
    assert metrics.roc_auc(labelled(spark, [(1, 1, 0.5), (1, 1, 0.6)])).first()["auc"] is None


@pytest.mark.parametrize(
    "pairs, mse, r2",
    [
        ([(i, i) for i in range(10)], 0.0, 1.0),
        ([(10, 0), (20, 0), (30, 0)], 1400 / 3, -6.0),
        ([(1, 1.1), (2, 2.1), (3, 2.9), (1000, 900)], 2500.0075, None),
        ([(5, 4), (5, 6)], 1.0, "undefined"),
    ],
)
def test_regression_metrics(spark, pairs, mse, r2):
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pairs], "y double, y_hat double")
    row = metrics.regression_metrics(df).first()
    assert row["mse"] == pytest.approx(mse) and row["rmse"] == pytest.approx(math.sqrt(mse))
    if r2 == "undefined":
        assert row["r2"] is None
    else:
        assert row["r2"] < 1 if r2 is None else row["r2"] == pytest.approx(r2)


def test_a_stratum_of_many_values_is_refused(spark):
    with pytest.raises(ValueError, match="stratum"):
        with_folds(spark.range(3000).withColumn("s", F.col("id") % 1000), 3, label="s")


@pytest.mark.parametrize("rows", [40, 700])
def test_parts_do_not_depend_on_the_prefix(spark, monkeypatch, rows):
    df = settle(spark.range(rows).withColumn("s", F.col("id") % 3))
    wide = sorted(map(tuple, with_folds(df, 4, label="s", by=["id"], stored=True).collect()))
    monkeypatch.setattr(sampling, "_PREFIX_ROWS", 5)
    monkeypatch.setattr(sampling, "_LEAST_BITS", 1)
    assert sorted(map(tuple, with_folds(df, 4, label="s", by=["id"], stored=True).collect())) == wide


def test_quantiles_of_columns_of_few_values_take_out_no_rows(spark, monkeypatch):
    rows = spark.range(30_000).select((F.col("id") % 4).cast("double").alias("a"), F.when(F.col("id") % 3 == 0, 1.0).alias("b"))

    def taken_out(_):
        raise AssertionError("rows are taken out")

    monkeypatch.setattr(quantiles.F, "explode", taken_out)
    assert exact_quantiles(rows, ["a", "b"], [0.1, 0.4, 0.9]) == {"a": [0.0, 1.0, 3.0], "b": [1.0, 1.0, 1.0]}
