"""Fits at once against fits one by one, brute force and the engine's own models."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tidewatch.operators import evaluate
from tidewatch.operators.fits import fit_basis, fit_bayes, fit_linear, fit_trees


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    n = 900
    a, b, c = rng.normal(size=n), rng.integers(0, 6, n).astype(float), rng.normal(3, 2, n)
    y = (a + 0.4 * b + rng.normal(size=n) > 1.5).astype(int)
    return pd.DataFrame({"id": np.arange(n), "a": a, "b": b, "c": c, "y": y, "fold": np.arange(n) % 3})


@pytest.fixture(scope="module")
def table(spark, rows):
    df = spark.createDataFrame(rows).repartition(3)
    return df.withColumns({f"w{m}": (F.col("fold") != m).cast("double") for m in range(3)}).withColumn("half", F.when(F.col("y") == 1, 2.5).otherwise(0.5)).persist()


X, W = ["a", "b", "c"], ["w0", "w1", "w2"]


def test_logistic_folds_equal_single_fits(table):
    together = fit_linear(table, X, "y", [*W, "half"])
    assert together.gradient.max() < 1e-9 and together.passes < 20
    packed = VectorAssembler(inputCols=X, outputCol="x").transform(table)
    for m, w in enumerate([*W, "half"]):
        alone = LogisticRegression(featuresCol="x", labelCol="y", maxIter=300, tol=1e-12, **({"weightCol": "half"} if w == "half" else {})).fit(packed.where(F.col(w) > 0))
        assert np.allclose(together.coefficients[m], alone.coefficients.toArray(), atol=1e-5) and abs(together.intercepts[m] - alone.intercept) < 1e-5


def test_ridge_and_squared_hinge_are_stationary(table, rows):
    for loss in ("logistic", "squared_hinge"):
        fit = fit_linear(table, X, "y", W, loss, ridge=0.1)
        assert fit.gradient.max() < 1e-8
        scored = fit.score(table, "fold").toPandas()
        assert ((scored["score"] > 0.5) == (scored["y"] == 1)).mean() > 0.75
    part = rows[rows["fold"] != 1]
    z = (part[X] - part[X].mean()) / part[X].std()
    b = fit.coefficients[1] * part[X].std().to_numpy()
    eta = part[X].to_numpy() @ fit.coefficients[1] + fit.intercepts[1]
    side = 2 * part["y"].to_numpy() - 1
    slope = (z.to_numpy() * (-2 * side * np.maximum(0, 1 - side * eta))[:, None]).mean(0) + 0.1 * b
    assert np.abs(slope).max() < 1e-8


def test_separable_rows_end(spark):
    df = spark.createDataFrame([(float(i), int(i > 5), 1.0) for i in range(12)], "a double, y int, w double")
    fit = fit_linear(df, ["a"], "y", ["w"])
    assert np.isfinite(fit.coefficients).all() and fit.gradient.max() < 1e-4


def test_missing_features_are_refused(spark):
    with pytest.raises(ValueError):
        fit_linear(spark.createDataFrame([(None, 1, 1.0), (2.0, 0, 1.0)], "a double, y int, w double"), ["a"], "y", ["w"])


def brute_split(part, edges):
    best = (0.0, None, None)
    gini = lambda s: 1 - ((s.mean()) ** 2 + (1 - s.mean()) ** 2) if len(s) else 0.0
    y = part["y"].to_numpy()
    for j, f in enumerate(X):
        for c, e in enumerate(edges[j]):
            left = part[f].to_numpy() <= e
            if left.any() and not left.all():
                g = gini(y) - left.mean() * gini(y[left]) - (~left).mean() * gini(y[~left])
                if g > best[0] + 1e-12:
                    best = (g, j, c)
    return best


def test_tree_splits_of_all_folds_equal_brute_force(table, rows):
    edges = [np.linspace(-2, 2, 21), np.arange(5.0), np.linspace(-1, 7, 17)]
    grown = fit_trees(table, X, "y", "id", W, depth=3, edges=edges)
    for m in range(3):
        todo = [(0, rows[rows["fold"] != m])]
        while todo:
            node, part = todo.pop()
            assert abs(grown.share[m, node] - part["y"].mean()) < 1e-12 and grown.rows[m, node] == len(part)
            gain, j, c = brute_split(part, edges)
            if node < 7 and j is not None:
                assert (grown.feature[m, node], grown.cut[m, node]) == (j, c) and abs(grown.gain[m, node] - gain) < 1e-12
                left = part[X[j]] <= edges[j][c]
                todo += [(2 * node + 1, part[left]), (2 * node + 2, part[~left])]
            else:
                assert grown.feature[m, node] == -1
    scored = grown.score(table, "fold").toPandas()
    assert ((scored["score"] > 0.5) == (scored["y"] == 1)).mean() > 0.75


def test_forest_in_lots_is_the_same_and_learns(table, monkeypatch):
    from tidewatch.operators import fits

    whole = fit_trees(table, X, "y", "id", W, trees=60, depth=4)
    monkeypatch.setattr(fits, "CELLS", 20_000)
    lots = fit_trees(table, X, "y", "id", W, trees=60, depth=4)
    assert (whole.feature == lots.feature).all() and (whole.cut == lots.cut).all()
    assert len({tuple(f) for f in whole.feature[:60].tolist()}) > 10
    scored = whole.score(table, "fold").toPandas()
    assert ((scored["score"] > 0.5) == (scored["y"] == 1)).mean() > 0.8
    share = whole.rows[:, 0] / 600
    assert abs(share.mean() - 1) < 0.02 and share.std() > 0.01


@pytest.mark.parametrize("kind", ["gaussian", "multinomial"])
def test_bayes_equals_the_engines(table, rows, kind):
    fitted = fit_bayes(table, X, "y", W, kind)
    got = fitted.score(table, "fold").toPandas().set_index("id")
    for m in range(3):
        train, test = table.where(F.col("fold") != m), table.where(F.col("fold") == m)
        if kind == "multinomial":
            low = rows[rows["fold"] != m][X].min()
            shift = {f: F.greatest(F.col(f) - float(low[f]), F.lit(0.0)) for f in X}
            train, test = train.withColumns(shift), test.withColumns(shift)
        pack = VectorAssembler(inputCols=X, outputCol="x")
        alone = NaiveBayes(featuresCol="x", labelCol="y", modelType=kind).fit(pack.transform(train)).transform(pack.transform(test))
        for r in alone.select("id", F.col("prediction")).collect():
            assert (got.loc[r["id"], "score"] > 0.5) == (r["prediction"] == 1.0)


@pytest.mark.parametrize("model, settings", [("logistic_regression", {}), ("decision_tree", {}), ("svm", {}), ("random_forest", {"numTrees": 40}), ("gaussian_naive_bayes", {})])
def test_protocols_learn(table, rows, model, settings):
    df = table.select("id", "y", *X)
    runs = evaluate.cross_validate(df, model, X, "y", "id", k=3, **settings).toPandas()
    assert sorted(runs["run"]) == [1, 2, 3] and (runs["f1"] > runs["baseline_f1"]).all() and (runs[["tp", "tn", "fp", "fn"]].sum().sum() == 900)
    held = evaluate.repeated_holdout(df, model, X, "y", "id", seeds=[5, 6], weighted=True, **settings).toPandas()
    assert sorted(held["seed"]) == [5, 6] and (held["f1"] > held["baseline_f1"]).all() and held["threshold"].between(0.05, 0.95).all()


@pytest.mark.parametrize("width, exact", [(6, True), (60, False)])
def test_basis_of_narrow_and_wide_tables(spark, width, exact):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3)) @ rng.normal(size=(3, width)) * 2 + rng.normal(size=(400, width)) * 0.3 + 5
    names = [f"f{i}" for i in range(width)]
    basis = fit_basis(spark.createDataFrame(pd.DataFrame(x, columns=names)).repartition(4), names, 3)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    value = np.linalg.eigvalsh(np.cov(z.T))[::-1][:3]
    assert np.allclose(basis.variance, value, rtol=1e-9 if exact else 1e-6) and abs(basis.total - width) < 1e-9
    assert np.allclose(basis.axes.T @ basis.axes, np.eye(3), atol=1e-9)
    got = basis.error(spark.createDataFrame(pd.DataFrame(x, columns=names))).toPandas()["error"].mean()
    assert abs(got - (width - value.sum()) * 399 / 400 / width) < 1e-6


def test_poisson_draws_follow_their_limits():
    """Draws by whole numbers equal those by fractions."""
    from tidewatch.operators import fits

    h = np.random.default_rng(3).integers(0, 1 << 63, 200_000).astype(np.uint64)
    salt = fits._mix(np.array([7], np.uint64) + np.uint64((42 * 1_000_003) & 0xFFFFFFFF))
    draw = (fits._mix(h ^ salt) >> np.uint64(11)) / float(1 << 53)
    assert (fits._times(h, 42, 7) == np.searchsorted(fits._POISSON, draw, "right")).all()


def test_candidates_share_their_passes(table, monkeypatch):
    """Three ridges on two data sets are fitted together, each with its own ridge and as it is alone."""
    from tidewatch.operators import evaluate, fits

    tables, calls, whole = {"a": table, "b": table.where("id % 3 > 0")}, [], fits.fit_linear
    monkeypatch.setattr(fits, "fit_linear", lambda *a, **s: calls.append(len(a[3])) or whole(*a, **s))
    tried = {"plain": ("logistic_regression", {}), "ridge": ("logistic_regression", {"regParam": 0.1}), "strong": ("logistic_regression", {"regParam": 5.0})}
    got = {(r["dataset"], r["tuning_profile"]): r for r in evaluate.search_candidates(tables, tried, X, "y", "id").collect()}
    assert calls == [6] and len(got) == 6
    for (name, profile), r in got.items():
        alone = evaluate.repeated_holdout(tables[name], "logistic_regression", X, "y", "id", [42], **tried[profile][1]).first()
        assert [r[c] for c in ("tp", "tn", "fp", "fn", "validation_f1", "baseline_f1")] == [alone[c] for c in ("tp", "tn", "fp", "fn", "validation_f1", "baseline_f1")]


def test_every_row_is_scored_once(spark, table):
    """The measures of model and baseline come from one pass over the scored rows."""
    from tidewatch.operators import evaluate

    seen = spark.sparkContext.accumulator(0)

    def once(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    scored = table.select("id", "y", F.lit(0).alias("_fit"), F.lit(1.0).alias("prediction"))
    evaluate._measured(scored.mapInArrow(once, scored.schema), "y", F.col("prediction"), "id", [0.5], [1], [42], "holdout").collect()
    assert seen.value == 900
