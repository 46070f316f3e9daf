"""SQL for the queries that fit models: splits, scaling, closed-form fits and their scores, spelt out."""

from __future__ import annotations

from collections.abc import Sequence

from moorage.schema import DEFAULT_FEATURES
from queries.oracles import HASH, with_ctes

#: Features without the column that follows from the other differences, for a fit without penalty.
INDEPENDENT = [c for c in DEFAULT_FEATURES if c != "instances_diff"]
RIDGE, FOLDS = 1.0, 5

_PARTS = f"""
, parts AS (
  SELECT *, row_number() OVER (ORDER BY {HASH}) AS k,
    row_number() OVER (ORDER BY {HASH}) <= ceil(count(*) OVER () * 0.2E0) AS is_test FROM rolled),
train AS MATERIALIZED (SELECT * FROM parts WHERE NOT is_test)"""


def _scaled(source: str, to: str, features: Sequence[str], keep: str) -> str:
    """CTE ``to``: rows of ``source`` with features x0, x1, ... scaled as the training rows are."""
    quantiles = ", ".join(f"quantile_cont({c}, {q}) AS {c}_{n}" for c in features for n, q in ((1, 0.25), (2, 0.5), (3, 0.75)))
    columns = ", ".join(
        f"({c} - {c}_2) / CASE WHEN {c}_3 = {c}_1 THEN 1.0E0 ELSE {c}_3 - {c}_1 END AS x{i}" for i, c in enumerate(features)
    )
    return f", {to} AS MATERIALIZED (SELECT {keep}, {columns} FROM {source}, (SELECT {quantiles} FROM train))"


def _plain(source: str, to: str, features: Sequence[str], keep: str) -> str:
    columns = ", ".join(f"cast({c} AS double) AS x{i}" for i, c in enumerate(features))
    return f", {to} AS MATERIALIZED (SELECT {keep}, {columns} FROM {source})"


def _bayes(name: str, source: str, width: int) -> str:
    """CTE ``name``: one row with both classes' counts, means and variances."""

    def of(label: int, c: str) -> str:
        parts = ", ".join(f"avg(x{i}) AS {c}m{i}, var_pop(x{i}) AS {c}v{i}" for i in range(width))
        return f"(SELECT count(*) AS {c}n, {parts} FROM {source} WHERE status = {label})"

    most = "greatest(" + ", ".join(f"var_pop(x{i})" for i in range(width)) + ")"
    return f", {name} AS MATERIALIZED (SELECT * FROM {of(0, 'a')}, {of(1, 'b')}, (SELECT 1E-9 * {most} AS e FROM {source}))"


def _odds(width: int) -> str:
    """Log-odds of class 0 in a row of features beside one of :func:`_bayes`."""
    logs = " + ".join(f"ln(av{i} + e) - ln(bv{i} + e)" for i in range(width))
    parts = " + ".join(f"(x{i} - bm{i}) * (x{i} - bm{i}) / (bv{i} + e) - (x{i} - am{i}) * (x{i} - am{i}) / (av{i} + e)" for i in range(width))
    return f"(ln(an * 1.0E0 / bn) - 0.5E0 * ({logs}) + 0.5E0 * ({parts}))"


def _line(name: str, source: str, width: int, alpha: float) -> str:
    """CTE ``name``: one row with weights w0, w1, ... and the intercept b, by elimination on the normal equations."""
    entries = [(i, j, f"x{i}", f"x{j}" if j < width else "deployment_time") for i in range(width) for j in range(width + 1)]
    sums = ", ".join(f"covar_pop({a}, {b}) * count(*) AS s{i}_{j}" for i, j, a, b in entries if i <= j)
    cells = " UNION ALL ".join(
        f"SELECT {i} AS i, {j} AS j, s{min(i, j)}_{max(i, j)}{f' + {alpha}E0' if i == j else ''} AS v FROM {name}_s" for i, j, _, _ in entries
    )
    steps = "".join(
        f""", {name}_{p + 1} AS MATERIALIZED (
  SELECT r.i, r.j, CASE WHEN r.i = {p} THEN r.v / d.v ELSE r.v - f.v * e.v / d.v END AS v
  FROM {name}_{p} r JOIN {name}_{p} e ON e.i = {p} AND e.j = r.j JOIN {name}_{p} f ON f.i = r.i AND f.j = {p}
  JOIN {name}_{p} d ON d.i = {p} AND d.j = {p})"""
        for p in range(width)
    )
    weights = ", ".join(f"max(v) FILTER (i = {i}) AS w{i}" for i in range(width))
    means = ", ".join(f"avg(x{i}) AS m{i}" for i in range(width))
    shift = " + ".join(f"w{i} * m{i}" for i in range(width))
    return f"""
, {name}_s AS MATERIALIZED (SELECT {sums} FROM {source}), {name}_0 AS MATERIALIZED ({cells}){steps}
, {name} AS MATERIALIZED (
  SELECT *, m - ({shift}) AS b FROM (SELECT {weights} FROM {name}_{width} WHERE j = {width}),
    (SELECT avg(deployment_time) AS m, {means} FROM {source}))"""


def _value(width: int) -> str:
    return "(b + " + " + ".join(f"w{i} * x{i}" for i in range(width)) + ")"


def _auc(rows: str, by: str = "") -> str:
    """Area under the ROC curve of (y, score), of each group of ``by``."""
    key, part = (f"{by}, ", f"PARTITION BY {by} ") if by else ("", "")
    return f"""
SELECT {key}(sum(place) FILTER (y = 1) - n1 * (n1 + 1) / 2.0E0) / (n1 * n0) AS auc FROM (
  SELECT *, count(*) FILTER (y = 1) OVER ({part}) * 1.0E0 AS n1, count(*) FILTER (y = 0) OVER ({part}) * 1.0E0 AS n0,
    rank() OVER ({part}ORDER BY score) + (count(*) OVER (PARTITION BY {key}score) - 1) / 2.0E0 AS place FROM ({rows}))
GROUP BY {key}n1, n0"""


def _share(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} = 0 THEN 0.0E0 ELSE ({part}) / cast({whole} AS double) END"


def _significant(value: str) -> str:
    """Six digits, as numbers of any size are compared."""
    return f"CASE WHEN {value} = 0 THEN 0.0E0 ELSE round({value}, cast(5 - floor(log10(abs({value}))) AS integer)) END"


_WIDTH = len(DEFAULT_FEATURES)
_CLASS_METRICS = {
    "accuracy": _share("tp + tn", "(tp + fp + fn + tn)"),
    "precision": _share("tp", "(tp + fp)"),
    "recall": _share("tp", "(tp + fn)"),
    "f1": _share("2 * tp", "(2 * tp + fp + fn)"),
}
_ERRORS = {
    "mse": "avg((y - y_hat) * (y - y_hat))",
    "rmse": "sqrt(avg((y - y_hat) * (y - y_hat)))",
    "mae": "avg(abs(y - y_hat))",
    "r2": "1 - avg((y - y_hat) * (y - y_hat)) / var_pop(y)",
}


def _classifier() -> str:
    scored = f"SELECT is_test, status AS y, 1 / (1 + exp(odds)) AS score, CASE WHEN odds < 0 THEN 1 ELSE 0 END AS y_hat FROM (SELECT *, {_odds(_WIDTH)} AS odds FROM scaled, nb)"
    counts = ", ".join(f"count(*) FILTER (y = {y} AND y_hat = {h}) AS {n}" for n, y, h in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0)))
    rows = [f"SELECT '{m}' AS metric, is_test, {sql} AS value FROM c" for m, sql in _CLASS_METRICS.items()]
    rows.append(f"SELECT 'auc', is_test, auc FROM ({_auc('SELECT * FROM s', 'is_test')})")
    return with_ctes(
        ["rolled"],
        f"""{_PARTS}{_scaled("parts", "scaled", DEFAULT_FEATURES, "is_test, status")}
, learn AS (SELECT * FROM scaled WHERE NOT is_test){_bayes("nb", "learn", _WIDTH)}
, s AS MATERIALIZED ({scored}), c AS (SELECT is_test, {counts} FROM s GROUP BY is_test)
SELECT metric || CASE WHEN is_test THEN '_test' ELSE '_train' END AS metric, {_significant("value")} AS value FROM ({" UNION ALL ".join(rows)})""",
    )


def _regressor() -> str:
    rows = " UNION ALL ".join(f"SELECT '{m}' AS metric, is_test, {sql} AS value FROM s GROUP BY is_test" for m, sql in _ERRORS.items())
    return with_ctes(
        ["rolled"],
        f"""{_PARTS}{_scaled("parts", "scaled", DEFAULT_FEATURES, "is_test, deployment_time")}
, learn AS (SELECT * FROM scaled WHERE NOT is_test){_line("line", "learn", _WIDTH, RIDGE)}
, s AS (SELECT is_test, deployment_time AS y, {_value(_WIDTH)} AS y_hat FROM scaled, line)
SELECT metric || CASE WHEN is_test THEN '_test' ELSE '_train' END AS metric, {_significant("value")} AS value FROM ({rows})""",
    )


def _folds(to: str, stratum: str) -> str:
    """CTE ``to``: training rows with their fold, strata laid end to end and dealt in turn."""
    return f"""
, {to}_n AS (SELECT {stratum} AS g, count(*) AS n, sum(count(*)) OVER (ORDER BY min({stratum})) AS stop FROM train GROUP BY ALL),
{to}_e AS (
  SELECT g, i, sum((stop - i + {FOLDS - 1}) // {FOLDS} - (stop - n - i + {FOLDS - 1}) // {FOLDS}) OVER (PARTITION BY g ORDER BY i) AS reached
  FROM {to}_n, range({FOLDS}) AS f(i)),
{to} AS MATERIALIZED (
  SELECT t.*, (SELECT min(i) FROM {to}_e WHERE g = t.g AND t.place <= reached) AS fold
  FROM (SELECT *, {stratum} AS g, row_number() OVER (PARTITION BY {stratum} ORDER BY {HASH}) AS place FROM train) t)"""


def _cross_validation() -> str:
    width = len(INDEPENDENT)
    sql = _PARTS + _folds("dealt_c", "status") + _scaled("dealt_c", "classes", DEFAULT_FEATURES, "fold, status")
    sql += _folds("dealt_r", "0") + _scaled("dealt_r", "durations", INDEPENDENT, "fold, deployment_time")
    scores = []
    for k in range(FOLDS):
        sql += f", c{k} AS (SELECT * FROM classes WHERE fold <> {k}){_bayes(f'nb{k}', f'c{k}', _WIDTH)}"
        rows = f"SELECT status AS y, 1 / (1 + exp({_odds(_WIDTH)})) AS score FROM classes, nb{k} WHERE fold = {k}"
        scores.append(f"SELECT 'GaussianNB' AS name, auc AS score FROM ({_auc(rows)})")
        sql += f", r{k} AS (SELECT * FROM durations WHERE fold <> {k})"
        for name, alpha in (("LinearRegression", 0.0), ("Ridge", RIDGE)):
            line = f"{name.lower()}{k}"
            sql += _line(line, f"r{k}", width, alpha)
            rows = f"SELECT deployment_time AS y, {_value(width)} AS y_hat FROM durations, {line} WHERE fold = {k}"
            scores.append(f"SELECT '{name}', {_ERRORS['r2']} FROM ({rows})")
    return with_ctes(
        ["rolled"],
        f"""{sql}
SELECT name, round(avg(score), 6) AS mean_score, round(stddev_pop(score), 6) AS std_score FROM ({" UNION ALL ".join(scores)}) GROUP BY name""",
    )


def _importances() -> str:
    means = ", ".join(f"avg(x{i}) AS o{i}" for i in range(_WIDTH))
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, avg(abs(w{i} * (x{i} - o{i}))) AS value FROM scaled, line, (SELECT {means} FROM scaled)"
        for i, c in enumerate(DEFAULT_FEATURES)
    )
    return with_ctes(
        ["rolled"],
        f"""{_PARTS}{_scaled("train", "scaled", DEFAULT_FEATURES, "deployment_time")}{_line("line", "scaled", _WIDTH, RIDGE)}
SELECT feature, {_significant("value")} AS importance, 0.0E0 AS standard_error FROM ({rows})""",
    )


def _weights() -> str:
    rows = " UNION ALL ".join(f"SELECT '{c}' AS feature, w{i} AS value FROM line" for i, c in enumerate(DEFAULT_FEATURES))
    return with_ctes(
        ["rolled"],
        f"""{_PARTS}{_scaled("train", "scaled", DEFAULT_FEATURES, "deployment_time")}{_line("line", "scaled", _WIDTH, RIDGE)}
SELECT cast(row_number() OVER (ORDER BY value DESC) AS integer) AS place, feature, {_significant("value")} AS importance FROM ({rows})""",
    )


def _ranking() -> str:
    """Both models' answers for all candidates, weighed and ranked."""
    kept = "msg_id, provider, pos, resource_exactness, min_success_time, max_success_time"
    return with_ctes(
        ["rolled", "enriched"],
        f"""{_PARTS}{_plain("train", "learn", DEFAULT_FEATURES, "status")}{_bayes("nb", "learn", _WIDTH)}
{_scaled("train", "lengths", DEFAULT_FEATURES, "deployment_time")}{_line("line", "lengths", _WIDTH, RIDGE)}
, complexity AS (SELECT *, CASE WHEN template_name IN ('PROMO', 'MEDIUM') THEN 1 ELSE 0 END AS complexity FROM enriched)
{_plain("complexity", "asked", DEFAULT_FEATURES, kept)}{_scaled("complexity", "asked_scaled", DEFAULT_FEATURES, "msg_id, provider")}
, p AS (SELECT asked.*, 1 / (1 + exp(-{_odds(_WIDTH)})) AS p_success FROM asked, nb),
t AS (SELECT msg_id, provider, {_value(_WIDTH)} AS expected FROM asked_scaled, line),
both_ways AS (
  SELECT p.*, p_success * 0.75E0 AS classification, 0.25E0 * CASE WHEN max_success_time > 0 AND max_success_time <> min_success_time
    THEN least(greatest(1 - (expected - min_success_time) / (max_success_time - min_success_time), 0.0E0), 1.0E0) ELSE 1.0E0 END AS regression
  FROM p JOIN t USING (msg_id, provider))
SELECT msg_id, provider, round(classification, 6) AS classification, round(regression, 6) AS regression,
  cast(row_number() OVER (PARTITION BY msg_id ORDER BY resource_exactness DESC, classification + regression DESC, pos) AS integer) AS rank
FROM both_ways""",
    )


def _round_trip() -> str:
    values = ", ".join(f"{_significant(m)} AS {m}" for m in ("mse", "mae", "r2"))
    return with_ctes(
        ["rolled"],
        f"""{_PARTS}{_scaled("parts", "scaled", DEFAULT_FEATURES, "is_test, deployment_time")}
, learn AS (SELECT * FROM scaled WHERE NOT is_test){_line("line", "learn", _WIDTH, RIDGE)}
, s AS (SELECT deployment_time AS y, {_value(_WIDTH)} AS y_hat FROM scaled, line WHERE is_test)
SELECT 'Ridge' AS name, 2 AS version, cast(2 AS bigint) AS stored_versions, {RIDGE}E0 AS alpha, {values}
FROM (SELECT {", ".join(f"{sql} AS {m}" for m, sql in _ERRORS.items())} FROM s)""",
    )


MODEL_ORACLES: dict[str, str] = {
    "train_classifier": _classifier(),
    "train_regressor": _regressor(),
    "cross_validate": _cross_validation(),
    "shapley_importance": _importances(),
    "score_and_rank_models": _ranking(),
    "registry_round_trip": _round_trip(),
    "coefficient_importance": _weights(),
}
