"""Evaluation protocols: folds, repeated hold-out, transfer between regimes, suites.

The folds, seeds and data sets of a protocol are weight columns of one table, so
all of them are fitted in the same passes where the model allows it; what a
protocol returns is a DataFrame of run metrics.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.portable import clip01, uniform
from ..shared import written
from .balance import exact_downsample, smote
from .fits import AT_ONCE, fit_at_once
from .metrics import confusion, run_summary, with_measures
from .models import family_of, fit, reconstruct, with_scores
from .ranktest import signed_rank_test
from .splits import stratified_folds, stratified_holdout
from .thresholds import pick_classifier_threshold, pick_error_threshold

# Published seeds of the random baselines, of the hold-outs and of the runs between regimes.
BASELINE_SEED = {"folds": 10_000, "holdout": 20_000}
HOLDOUT_SEEDS = (42, 52, 62)
TRANSFER_SEEDS = (42, 52, 62, 72, 82)
#: Models whose fits may each have a ridge of their own, with the default one.
RIDGE = {"logistic_regression": 0.0, "svm": 0.1}


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _kept(df: DataFrame, name: str, id_col: str) -> DataFrame:
    """Written once for the passes of the fits; a table that would be read by fewer tasks than there are cores is dealt out anew."""
    out, cores = written(df, name), df.sparkSession.sparkContext.defaultParallelism
    return out if out.rdd.getNumPartitions() >= cores else written(out.repartition(cores, id_col), name)


def _picked(values: list, which: str) -> Column:
    """The value at the place that a column names."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col(which).cast("int") + 1)


def _measured(scored: DataFrame, label: str, prediction, id_col: str, rates: list[float], runs: list[int], seeds: list[int], protocol: str) -> DataFrame:
    """One row per fit: measures of the model and F1 of a random baseline with the training positive rate.

    ``scored`` names the fit of a row in ``_fit``; all fits are counted in one pass.
    """
    base = F.lit(BASELINE_SEED[protocol]) + _picked(seeds, "_fit") + _picked(runs, "_fit")
    guess = (uniform(base, id_col) < clip01(_picked([float(r) for r in rates], "_fit"))).cast("double")
    both = scored.select(label, "_fit", F.inline(F.array(F.struct(F.lit("model").alias("who"), prediction.alias("p")),
                                                         F.struct(F.lit("baseline").alias("who"), guess.alias("p")))))
    # A few rows that are read twice; without it every row would be scored twice.
    rated = written(with_measures(confusion(both, label, "p", ["_fit", "who"])), "rated")
    theirs = rated.where("who = 'baseline'").select("_fit", F.col("f1").alias("baseline_f1"))
    out = rated.where("who = 'model'").drop("who").join(theirs, "_fit")
    return out.withColumns({"run": _picked(runs, "_fit"), "seed": _picked(seeds, "_fit")})


def _rates(df: DataFrame, label: str, weights: list[str]) -> list[float]:
    """Positive rate of each fit's training rows."""
    row = df.agg(*[F.avg(F.when(F.col(w) > 0, F.col(label).cast("double"))).alias(w) for w in weights]).first()
    return [row[w] or 0.0 for w in weights]


def _scored(model: str, df: DataFrame, features: list[str], label: str, id_col: str, weights: list[str], tested: DataFrame, **settings) -> tuple[DataFrame, list[float]]:
    """(``tested`` with score and prediction of the fit that ``_fit`` names, gradient left in each fit or NaN).

    Models that take many weight columns are fitted together; the others one after another.
    """
    if model in AT_ONCE:
        fitted = fit_at_once(model, df, features, label, id_col, weights, **settings)
        out = fitted.score(tested, "_fit").withColumn("prediction", (F.col("score") > 0.5).cast("double"))
        return out, [float(g) for g in getattr(fitted, "gradient", [math.nan] * len(weights))]
    parts = []
    for i, w in enumerate(weights):
        train = df.where(F.col(w) > 0)
        parts.append(with_scores(fit(model, train, features, label, **settings), tested.where(F.col("_fit") == i)))
    return _union(parts), [math.nan] * len(weights)


def _with_gradient(runs: DataFrame, gradient: list[float]) -> DataFrame:
    return runs if all(math.isnan(g) for g in gradient) else runs.withColumn("gradient", _picked(gradient, "_fit"))


def cross_validate(df: DataFrame, model: str, features: list[str], label: str, id_col: str, k: int = 5,
                   seed: int = 42, **settings) -> DataFrame:
    """Stratified k-fold runs with a baseline per fold; scalers are fit on the training folds only. All folds share their passes."""
    return _fold_runs({"": df}, model, features, label, id_col, k, seed, **settings).drop("dataset")


def _folded(datasets: dict[str, DataFrame], features: list[str], label: str, id_col: str, k: int, seed: int) -> tuple[DataFrame, list[str]]:
    """All data sets in one table: _fit (data set and fold), and one weight column per fit."""
    parts = [stratified_folds(df, label, id_col, k, seed).select(id_col, label, *features, (F.col("fold") + i * k).alias("_fit"))
             for i, df in enumerate(datasets.values())]
    fits = len(datasets) * k
    weights = [f"_w{i}" for i in range(fits)]
    same = lambda i: F.floor(F.col("_fit") / k) == i // k
    whole = _union(parts).withColumns({w: (same(i) & (F.col("_fit") != i)).cast("double") for i, w in enumerate(weights)})
    return _kept(whole, "folds", id_col), weights


def _fold_runs(datasets: dict[str, DataFrame], model: str, features: list[str], label: str, id_col: str, k: int, seed: int,
               folded: tuple[DataFrame, list[str]] | None = None, **settings) -> DataFrame:
    whole, weights = folded or _folded(datasets, features, label, id_col, k, seed)
    tested = whole.select(id_col, label, *features, "_fit")
    scored, gradient = _scored(model, whole, features, label, id_col, weights, tested, **settings)
    names, fits = list(datasets), len(weights)
    runs = _measured(scored, label, F.col("prediction"), id_col, _rates(whole, label, weights), [i % k + 1 for i in range(fits)], [seed] * fits, "folds")
    return _with_gradient(runs, gradient).withColumn("dataset", _picked([names[i // k] for i in range(fits)], "_fit")).drop("_fit")


def repeated_holdout(df: DataFrame, model: str, features: list[str], label: str, id_col: str,
                     seeds: list[int] = HOLDOUT_SEEDS, weighted: bool = False, **settings) -> DataFrame:
    """Train, tune the threshold on validation rows, test; once per seed, all seeds in the same passes."""
    whole = df
    for i, seed in enumerate(seeds):
        whole = stratified_holdout(whole, label, id_col, seed).withColumnRenamed("split", f"_s{i}")
    weights = [f"_w{i}" for i in range(len(seeds))]
    trained = {w: F.col(f"_s{i}") == "train" for i, w in enumerate(weights)}
    whole = _kept(whole.withColumns({w: on.cast("double") for w, on in trained.items()}), "holdout", id_col)
    rates = _rates(whole, label, weights)
    if weighted:
        # Two classes: total / (2 * count), where the larger has at least 1.2 times the rows of the smaller.
        even = [(0.5 / (1 - r), 0.5 / r) if 0 < r < 1 and max(r, 1 - r) / min(r, 1 - r) >= 1.2 else (1.0, 1.0) for r in rates]
        whole = written(whole.withColumns({w: F.col(w) * F.when(F.col(label) == 1, b).otherwise(a) for w, (a, b) in zip(weights, even)}), "weighted")
        if model not in AT_ONCE:
            raise ValueError(f"{model} takes no class weights here")
    listed = F.array(*[F.struct(F.lit(i).alias("_fit"), F.col(f"_s{i}").alias("_split")) for i in range(len(seeds))])
    tested = whole.select(id_col, label, *features, F.inline(listed)).where("_split != 'train'")
    scored, gradient = _scored(model, whole, features, label, id_col, weights, tested, **settings)
    return _with_gradient(_tuned(scored, label, id_col, rates, list(range(1, len(seeds) + 1)), list(seeds)), gradient).drop("_fit")


def _tuned(scored: DataFrame, label: str, id_col: str, rates: list[float], runs: list[int], seeds: list[int]) -> DataFrame:
    """One row per fit: measures on test rows at the threshold that is best on validation rows (``_split``)."""
    scored = written(scored.select(id_col, label, "_fit", "_split", "score"), "holdout-scores")
    tuned = {r["_fit"]: r for r in pick_classifier_threshold(scored.where("_split = 'validation'"), "score", label, ["_fit"]).collect()}
    cuts, best = ([float(tuned[i][c]) if i in tuned else fill for i in range(len(seeds))] for c, fill in (("threshold", 0.5), ("f1", 0.0)))
    out = _measured(scored.where("_split = 'test'"), label, (F.col("score") >= _picked(cuts, "_fit")).cast("double"), id_col, rates, runs, seeds, "holdout")
    return out.withColumns({"threshold": _picked(cuts, "_fit"), "validation_f1": _picked(best, "_fit")})


def _run(scored: DataFrame, label: str, prediction, id_col: str, train: DataFrame, run: int, seed: int, protocol: str) -> DataFrame:
    """One row for one fit."""
    rate = train.agg(F.avg(F.col(label).cast("double")).alias("p")).first()["p"] or 0.0
    return _measured(scored.withColumn("_fit", F.lit(0)), label, prediction, id_col, [rate], [run], [seed], protocol).drop("_fit")


def fixed_split(train: DataFrame, test: DataFrame, model: str, features: list[str], label: str, id_col: str,
                seed: int = 42, **settings) -> DataFrame:
    """Fit on one table, measure on another."""
    tested = test.withColumn("_fit", F.lit(0))
    whole = _kept(train.select(id_col, label, *features, F.lit(1.0).alias("_w")), "train", id_col)
    scored, gradient = _scored(model, whole, features, label, id_col, ["_w"], tested, **settings)
    return _with_gradient(_measured(scored, label, F.col("prediction"), id_col, _rates(whole, label, ["_w"]), [1], [seed], "holdout"), gradient).drop("_fit")


def oversampled(train: DataFrame, features: list[str], label: str, id_col: str, seed: int, **search) -> DataFrame:
    """SMOTE on plain feature columns."""
    packed = train.select(id_col, label, F.array(*[F.col(f).cast("double") for f in features]).alias("_v"))
    grown = smote(packed, label, id_col, "_v", seed=seed, **search)
    flat = grown.select(id_col, label, *[F.col("_v")[i].alias(f) for i, f in enumerate(features)])
    return written(flat, "oversampled")


def generalize(a: DataFrame, b: DataFrame, model: str, features: list[str], label: str, id_col: str,
               names: tuple[str, str] = ("a", "b"), seeds: list[int] = TRANSFER_SEEDS, **settings) -> DataFrame:
    """Train on one regime (oversampled), test on the other, both ways and for every seed.

    Both regimes are oversampled for all seeds in one set of jobs, and all fits share their passes. A regime's own rows take part in
    the fits of all its seeds, so they stand in the table once.
    """
    columns = [id_col, label, F.array(*[F.col(f).cast("double") for f in features]).alias("_v")]
    both = _union([d.select(*columns, F.lit(i).alias("_source")) for i, d in enumerate((a, b))])
    both = written(both, "regimes")
    grown = smote(both, label, id_col, "_v", by=["_source"], seeds=list(seeds))
    flat = [F.col("_v")[i].alias(f) for i, f in enumerate(features)]
    takes_part = lambda i: (F.col("_source") == i // len(seeds)) & (F.col("_seed").isNull() | (F.col("_seed") == seeds[i % len(seeds)]))
    weights = [f"_w{i}" for i in range(2 * len(seeds))]
    train = _kept(grown.select(id_col, label, *flat, *[takes_part(i).cast("double").alias(w) for i, w in enumerate(weights)]), "oversampled", id_col)
    tested = both.select(id_col, label, *flat, "_source", F.explode(F.sequence(F.lit(0), F.lit(len(seeds) - 1))).alias("_n")).withColumn(
        "_fit", (1 - F.col("_source")) * len(seeds) + F.col("_n")).drop("_n", "_source")
    scored, gradient = _scored(model, train, features, label, id_col, weights, tested, **settings)
    after = _rates(train, label, weights)
    raw = [r["r"] for r in both.groupBy("_source").agg(F.avg(F.col(label).cast("double")).alias("r")).orderBy("_source").collect()]
    way = [i // len(seeds) for i in range(len(weights))]
    runs = _measured(scored, label, F.col("prediction"), id_col, after, [1] * len(weights), [s for _ in range(2) for s in seeds], "holdout")
    return _with_gradient(runs, gradient).withColumns({
        "train_source": _picked([names[w] for w in way], "_fit"), "test_source": _picked([names[1 - w] for w in way], "_fit"),
        "positive_rate_train_raw": _picked([raw[w] for w in way], "_fit"), "positive_rate_train_after_smote": _picked(after, "_fit"),
        "positive_rate_test": _picked([raw[1 - w] for w in way], "_fit")}).drop("_fit")


def pooled_holdout(a: DataFrame, b: DataFrame, model: str, features: list[str], label: str, id_col: str,
                   seed: int = 42, test: float = 0.3, **settings) -> DataFrame:
    """One split of both regimes together, with and without a column that names the source."""
    pooled = a.withColumn("source_indicator", F.lit(0.0)).unionByName(b.withColumn("source_indicator", F.lit(1.0)))
    split = written(stratified_holdout(pooled, label, id_col, seed, test, 0.0), "pooled")
    train, held = split.where("split = 'train'"), split.where("split = 'test'")
    runs = []
    for used in (features, [*features, "source_indicator"]):
        grown = oversampled(train, used, label, id_col, seed)
        runs.append(fixed_split(grown, held, model, used, label, id_col, seed, **settings).withColumn(
            "feature_count", F.lit(len(used))))
    return _union(runs)


def reconstruction_holdout(df: DataFrame, features: list[str], label: str, id_col: str, components: int,
                           seed: int = 42) -> DataFrame:
    """Detector fit on normal training rows; the error threshold is tuned on validation rows."""
    split = written(stratified_holdout(df, label, id_col, seed), "holdout")
    normal = split.where((F.col("split") == "train") & (F.col(label) == 0))
    rated = reconstruct(normal, split.where(F.col("split") != "train"), features, components)
    tuned = pick_error_threshold(rated.where("split = 'validation'"), "error", label).first()
    run = _run(rated.where("split = 'test'"), label, (F.col("error") >= tuned["threshold"]).cast("double"), id_col,
               split.where("split = 'train'"), 1, seed, "holdout")
    return run.withColumns({"threshold": F.lit(tuned["threshold"]), "validation_f1": F.lit(tuned["f1"])})


def balanced_network(df: DataFrame, features: list[str], label: str, id_col: str, seed: int = 42,
                     **settings) -> DataFrame:
    """Spark's feed-forward network on downsampled training rows; it takes no row weights."""
    split = written(stratified_holdout(df, label, id_col, seed), "holdout")
    even = written(exact_downsample(split.where("split = 'train'"), label, id_col, seed), "even")
    return fixed_split(even, split.where("split = 'test'"), "neural_network", features, label, id_col, seed,
                       **settings)


def search_candidates(datasets: dict[str, DataFrame], candidates: dict[str, tuple[str, dict]], features: list[str],
                      label: str, id_col: str, seed: int = 42) -> DataFrame:
    """Validation and test F1 of every candidate on every dataset.

    All datasets are split into one table; linear candidates that differ in ``regParam`` only share their passes.
    """
    names = list(datasets)
    parts = [stratified_holdout(df, label, id_col, seed).select(id_col, label, *features, "split", F.lit(i).alias("_data"))
             for i, df in enumerate(datasets.values())]
    whole = _kept(_union(parts), "candidates", id_col)
    together: dict[object, list[tuple[int, str, str, dict]]] = {}
    for place, (profile, (model, settings)) in enumerate(candidates.items()):
        others = repr(sorted((k, v) for k, v in settings.items() if k != "regParam"))
        together.setdefault((model, others) if model in RIDGE else place, []).append((place, profile, model, settings))
    runs = []
    for tried in together.values():
        fits = [(i, place, profile, settings) for place, profile, _, settings in tried for i in range(len(names))]
        model, settings = tried[0][2], dict(tried[0][3])
        if model in RIDGE:
            settings["regParam"] = [own.get("regParam", RIDGE[model]) for _, _, _, own in fits]
        weights = [f"_w{j}" for j in range(len(fits))]
        table = whole.withColumns({w: ((F.col("split") == "train") & (F.col("_data") == i)).cast("double") for w, (i, *_) in zip(weights, fits)})
        held = F.explode(F.array(*[F.lit(c * len(names)) + F.col("_data") for c in range(len(tried))]))
        tested = whole.where("split != 'train'").select(id_col, label, *features, F.col("split").alias("_split"), held.alias("_fit"))
        scored, _ = _scored(model, table, features, label, id_col, weights, tested, **settings)
        run = _tuned(scored, label, id_col, _rates(table, label, weights), [1] * len(fits), [seed] * len(fits))
        runs.append(run.select(_picked([names[i] for i, *_ in fits], "_fit").alias("dataset"), F.lit(model).alias("model"),
                               _picked([profile for _, _, profile, _ in fits], "_fit").alias("tuning_profile"),
                               _picked([place for _, place, _, _ in fits], "_fit").alias("place"),
                               "validation_f1", F.col("f1").alias("test_f1"), "baseline_f1", "tp", "tn", "fp", "fn"))
    return _union(runs)


def summarize(runs: DataFrame, by: list[str]) -> DataFrame:
    """Run summary, baseline summary and the signed-rank test against the baseline, one row per group."""
    flat = run_summary(runs, by)
    base = runs.groupBy(*by).agg(F.avg("baseline_f1").alias("baseline_f1_mean"),
                                 F.stddev_pop("baseline_f1").alias("baseline_f1_std"))
    test = signed_rank_test(runs, by, "f1", "baseline_f1").select(*by, "p_value", "significant", "direction")
    return flat.join(base, by).join(test, by)


def suite(datasets: dict[str, DataFrame], model_settings: dict[str, dict], features: list[str], label: str,
          id_col: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Run metrics of every model on every dataset that holds both classes; a model's folds of all datasets share their passes."""
    usable = {name: df for name, df in datasets.items() if df.select(label).distinct().limit(2).count() == 2}
    if not usable:
        raise ValueError("no dataset holds both classes")
    folded = _folded(usable, features, label, id_col, k, seed)
    runs = [_fold_runs(usable, model, features, label, id_col, k, seed, folded, **settings).withColumns(
        {"model": F.lit(model), "family": F.lit(family_of(model))}) for model, settings in model_settings.items()]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), runs)


def batch_score(model, sources: list[DataFrame], name: str = "score") -> DataFrame:
    """Score the union of several sources; the first one sets the column order."""
    whole = reduce(lambda x, y: x.unionByName(y.select(*x.columns)), sources)
    return with_scores(model, whole, name)

