"""Measures, thresholds, routing, rank tests, KPIs, splits and protocols."""

import itertools

import numpy as np
import pandas as pd
import pytest
from helpers import close
from pyspark.sql import functions as F

from tidewatch.operators import evaluate, metrics, models, profile, quality, reports, scaling
from tidewatch.operators.ranktest import average_ranks, differences, null_distribution, signed_rank_test
from tidewatch.operators.routing import Policy, policy_quality, threshold_sweep
from tidewatch.operators.splits import hash_split, stratified_folds, stratified_holdout
from tidewatch.operators.thresholds import pick_classifier_threshold, pick_error_threshold


def test_empty_denominators_are_zero(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "y int, p int")
    r = metrics.evaluate(df, "y", "p").first()
    assert (r["tp"], r["tn"], r["fp"], r["fn"]) == (0, 1, 0, 1)
    assert r["precision"] == r["f1"] == 0.0 and r["accuracy"] == 0.5 and r["error_rate"] == 0.5


def test_class_weights_only_from_a_ratio(spark):
    near = spark.createDataFrame([(0,)] * 11 + [(1,)] * 10, "y int")
    far = spark.createDataFrame([(0,)] * 12 + [(1,)] * 10, "y int")
    assert metrics.class_weights(near, "y").count() == 0
    assert {r["y"]: r["weight"] for r in metrics.class_weights(far, "y").collect()} == {0: 22 / 24, 1: 22 / 20}
    assert models.with_class_weights(near, "y").select("class_weight").distinct().collect()[0][0] == 1.0
    assert {round(r[0], 6) for r in models.with_class_weights(far, "y").select("class_weight").collect()} == {round(22 / 24, 6), 1.1}


def test_imbalance_reads_text_labels(spark):
    df = spark.createDataFrame([("0",), ("0.0",), ("1",), ("1.0",), ("x",)], "Labels string")
    r = profile.imbalance(df).first()
    assert (r["total_rows"], r["normal_rows"], r["anomaly_rows"], r["label_column"]) == (5, 2, 2, "Labels")
    assert profile.imbalance(df.withColumnRenamed("Labels", "other")).first()["label_column"] == "N/A"


def test_class_role_ties_go_to_the_smallest_label(spark):
    df = spark.createDataFrame([(3,), (1,), (1,), (3,)], "y int")
    r = profile.class_roles(df, "y").first()
    assert r["majority"] == r["minority"] == 1 and r["to_generate"] == 0


def brute_threshold(scores, labels, grid):
    best, chosen = None, None
    for t in grid:
        p = scores >= t
        tp, fp, fn = (p & (labels == 1)).sum(), (p & (labels == 0)).sum(), (~p & (labels == 1)).sum()
        pr, rc = (tp / (tp + fp) if tp + fp else 0.0), (tp / (tp + fn) if tp + fn else 0.0)
        sig = (2 * pr * rc / (pr + rc) if pr + rc else 0.0, pr, rc, -((fp + fn) / len(labels)))
        if best is None or sig > best:
            best, chosen = sig, t
    return chosen


def test_threshold_choice_equals_the_loop(spark):
    rng = np.random.default_rng(4)
    labels = (rng.random(500) < 0.3).astype(int)
    scores = np.clip(rng.normal(0.35, 0.2, 500) + 0.25 * labels, 0, 1).round(2)
    df = spark.createDataFrame(pd.DataFrame({"s": scores, "y": labels}))
    got = pick_classifier_threshold(df, "s", "y").first()["threshold"]
    assert got == brute_threshold(scores, labels, [0.5, *np.linspace(0.05, 0.95, 37)])
    got = pick_error_threshold(df, "s", "y").first()["threshold"]
    assert got == brute_threshold(scores, labels, np.linspace(scores.min(), scores.max(), 41))


def test_constant_errors_give_that_threshold(spark):
    df = spark.createDataFrame([(2.5, 0), (2.5, 1)], "e double, y int")
    assert pick_error_threshold(df, "e", "y").first()["threshold"] == 2.5


def test_perfect_half_keeps_the_default_threshold(spark):
    df = spark.createDataFrame([(0.1, 0), (0.9, 1)], "s double, y int")
    assert pick_classifier_threshold(df, "s", "y").first()["threshold"] == 0.5


def test_policy_and_sweep(spark):
    rows = [(0.9, 1), (0.85, 0), (0.5, 1), (0.5, 0), (0.2, 0), (0.1, 1), (0.3, 0), (0.21, 0)]
    df = spark.createDataFrame(rows, "s double, y int")
    r = policy_quality(df, "s", "y", {"p": Policy()}).first()
    assert (r["anomaly_topic_count"], r["normal_topic_count"], r["uncertain_band_count"], r["review_topic_count"]) == (2, 2, 4, 4)
    assert close(r["precision_on_auto_alert"], 0.5) and close(r["recall_on_auto_alert"], 1 / 3)
    assert close(r["effective_recall_with_review"], 2 / 3) and close(r["residual_miss_rate_after_review"], 1 / 3)
    assert close(r["fpr_on_auto_alert"], 0.2) and r["normal_bucket_positive_count"] == 1
    swept = threshold_sweep(df, "s", "y").collect()
    assert len(swept) == 36 and sum(x["is_baseline"] for x in swept) == 1
    best = [x for x in swept if x["is_recommended"]]
    # Raising the lower bound to 0.3 reviews two rows instead of four at the same recall; ties stay nearest the baseline.
    assert len(best) == 1 and (best[0]["anomaly_threshold"], best[0]["normal_threshold"]) == (0.8, 0.3)


@pytest.mark.parametrize("n, p", [(1, 1.0), (3, 0.25), (5, 0.0625), (10, 0.001953125)])
def test_all_positive_differences(spark, n, p):
    df = spark.createDataFrame([(0.5 + i / 100, 0.1) for i in range(n)], "x double, y double")
    r = signed_rank_test(df, [], "x", "y").first()
    assert r["n"] == n and close(r["p_value"], p) and r["significant"] == (p < 0.05) and r["direction"] == "better_than_random"


def test_no_difference(spark):
    df = spark.createDataFrame([("a", 0.5, 0.5), ("a", 0.1, 0.1 + 1e-9), ("b", 1.0, 2.0)], "g string, x double, y double")
    rows = {r["g"]: r for r in signed_rank_test(df, ["g"], "x", "y").collect()}
    assert rows["a"]["n"] == 0 and rows["a"]["p_value"] == 1.0 and rows["a"]["direction"] == "no_difference"
    assert rows["b"]["direction"] == "worse_than_random"


def test_exact_p_equals_listing_all_sign_patterns(spark):
    d = np.array([0.3, -0.1, 0.2, 0.2, -0.2, 0.5, 0.05, -0.4])
    df = spark.createDataFrame([(float(x), 0.0) for x in d], "x double, y double")
    ranks = pd.Series(np.abs(d)).rank().to_numpy()
    w = min(ranks[d > 0].sum(), ranks[d < 0].sum())
    sums = [sum(r for r, s in zip(ranks, signs) if s) for signs in itertools.product((0, 1), repeat=len(d))]
    p = np.mean([min(s, ranks.sum() - s) <= w + 1e-12 for s in sums])
    got = signed_rank_test(df, [], "x", "y").first()
    assert close(got["p_value"], p) and close(got["median_difference"], np.median(d)) and got["statistic"] == w
    table = {(r["size"]): r["rank"] for r in average_ranks(differences(df, "x", "y"), []).collect()}
    assert close(table[0.2], 4.0)
    counts = spark.range(1).select(null_distribution(F.array(F.lit(2), F.lit(3), F.lit(3))).alias("c")).first()["c"]
    assert counts == [0.125, 0.0, 0.125, 0.25, 0.0, 0.25, 0.125, 0.0, 0.125]


def test_normal_approximation_is_close_to_exact(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(float(x), 0.0) for x in rng.normal(0.25, 1, 25)], "x double, y double")
    exact = signed_rank_test(df, [], "x", "y").first()["p_value"]
    assert abs(exact - signed_rank_test(df, [], "x", "y", method="normal").first()["p_value"]) < 0.02


def test_published_review_reduction(spark):
    row = [("a", 0.9608, 0.9621, 0.9614, 0.2221, 19634, 15117, 4517)]
    df = spark.createDataFrame(row, "dataset string, precision_mean double, recall_mean double, f1_mean double, "
                                    "baseline_f1_mean double, total_rows int, normal_rows int, anomaly_rows int")
    r = reports.operational_kpis(df).first()
    assert round(r["review_reduction"] * 100, 2) == 76.96 and round(r["predicted_positive"]) == 4523
    assert close(r["baseline_lift"], 0.9614 / 0.2221)


def test_zero_precision_raises_no_alarm(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0, 0, 0, 0)], "precision_mean double, recall_mean double, f1_mean double, "
                               "baseline_f1_mean double, total_rows int, normal_rows int, anomaly_rows int")
    r = reports.operational_kpis(df).first()
    assert all(r[c] == 0.0 for c in ("predicted_positive", "review_reduction", "review_compression", "baseline_lift", "miss_rate"))


def test_merge_keeps_the_last_source(spark):
    a = spark.createDataFrame([("d", "m", 0.1), ("d", "n", 0.2)], "dataset string, model string, f1 double")
    b = spark.createDataFrame([("d", "m", 0.9, "x")], "dataset string, model string, f1 double, note string")
    out = reports.merged_results([("first", a), ("second", b)], ["dataset", "model"])
    assert out.columns[:2] == ["dataset", "model"]
    assert {r["model"]: (r["f1"], r["result_source"], r["note"]) for r in out.collect()} == {
        "m": (0.9, "second", "x"), "n": (0.2, "first", None)}


def test_folds_and_holdout_are_even_and_disjoint(spark):
    df = spark.createDataFrame([(i, int(i < 23)) for i in range(100)], "id int, y int")
    folds = stratified_folds(df, "y", "id", 5).toPandas()
    sizes = folds.groupby(["y", "fold"]).size().unstack()
    assert len(folds) == 100 and (sizes.max(axis=1) - sizes.min(axis=1)).max() <= 1
    split = stratified_holdout(df, "y", "id").toPandas().groupby(["y", "split"]).size().unstack()
    assert split.loc[1].to_dict() == {"test": 5, "train": 14, "validation": 4}
    again = stratified_folds(df.repartition(7), "y", "id", 5).toPandas()
    assert folds.sort_values("id")["fold"].tolist() == again.sort_values("id")["fold"].tolist()


def test_scaling_fits_on_training_rows_only(spark):
    train = spark.createDataFrame([(0.0, 1.0), (10.0, 1.0)], "a double, b double")
    test = spark.createDataFrame([(20.0, 3.0)], "a double, b double")
    assert scaling.min_max(test, ["a", "b"], fit=train).first().asDict() == {"a": 2.0, "b": 0.0}
    r = scaling.standard(test, ["a"], fit=train, population=True).first()
    assert close(r["a"], 3.0)
    spread = spark.range(200).select(F.col("id").cast("double").alias("a"))
    assert close(scaling.robust(test.select("a"), ["a"], fit=spread).first()["a"], (20 - 99.5) / 159.2)
    assert scaling.min_shift(test.select("a"), ["a"], fit=train.withColumn("a", F.col("a") - 5)).first()["a"] == 25.0


def test_batch_delay_recurrence(spark):
    work = [12.0, 3.0, 1.0, 15.0, 2.0, 2.0, 30.0, 1.0]
    df = spark.createDataFrame([("g", i, w, 10) for i, w in enumerate(work)], "g string, b int, processing_s double, records int")
    end, delays = 0.0, []
    for i, w in enumerate(work):
        start = max(i * 10.0, end)
        delays.append(start - i * 10.0)
        end = start + w
    r = quality.batch_load(df, ["g"], "b", 10.0).first()
    assert close(r["mean_delay_ms"], 1000 * np.mean(delays)) and close(r["avg_process_s"], 80 / sum(work))


def test_replay_batches_drop_the_overflow(spark):
    rows = quality.replay_batches(spark, 300, 2, 5, 4).collect()
    want = [(i, i * 300 // 2000, i % 4) for i in range(5000 // 300) if i * 300 < 5000 and i * 300 // 2000 < 2]
    assert sorted((r["position"], r["batch"], r["reservoir_row"]) for r in rows) == want


def test_delay_matrix_fills_missing_cells(spark):
    df = spark.createDataFrame([(100, 5, 2.0), (100, 5, 4.0), (200, 20, 1.0), (200, 99, 7.0)], "flow int, i int, d double")
    rows = {r["flow"]: r.asDict() for r in quality.delay_matrix(df, "flow", "i", "d", [5, 10, 15, 20]).collect()}
    assert rows[100] == {"flow": 100, "5": 3.0, "10": 0.0, "15": 0.0, "20": 0.0} and rows[200]["20"] == 1.0


def test_message_quality_fixture(spark):
    df = spark.createDataFrame([(0, "a", 1), (1, "a", 3), (2, "b", 2)], "off int, id string, ts int")
    r = quality.message_quality(df, "off", "ts", "id", F.lit(True), F.lit(True)).first()
    assert (r["records"], r["duplicated_ids"], r["out_of_order"]) == (3, 1, 1)


def test_loss_rate_fixture(spark):
    from tidewatch.operators.joins import delivery

    sent = spark.createDataFrame([(str(i), "anomaly" if i < 2 else "normal") for i in range(5)], "id string, want string")
    got = spark.createDataFrame([("0", "anomaly"), ("1", "normal"), ("2", "normal"), ("3", "normal")], "id string, topic string")
    r = delivery(sent, got, "id", "want", "topic", "anomaly").first()
    assert close(r["message_loss_rate"], 0.2) and close(r["alert_delivery_success"], 0.5)


@pytest.fixture(scope="module")
def learnable(spark):
    rng = np.random.default_rng(2)
    y = (rng.random(400) < 0.3).astype(int)
    frame = pd.DataFrame({"id": np.arange(400), "label": y, "a": rng.normal(size=400) + 3 * y, "b": rng.normal(size=400) - 2 * y})
    return spark.createDataFrame(frame)


@pytest.mark.parametrize("model, settings", [("logistic_regression", {}), ("random_forest", {"numTrees": 5}), ("svm", {}),
                                             ("decision_tree", {}), ("naive_bayes", {}), ("gaussian_naive_bayes", {}),
                                             ("neural_network", {"maxIter": 30})])
def test_models_learn(spark, learnable, model, settings):
    split = hash_split(learnable, "id")
    train, test = split.where("split = 'train'"), split.where("split = 'test'")
    scored = models.with_scores(models.fit(model, train, ["a", "b"], "label", **settings), test).persist()
    assert scored.count() == test.count() and scored.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    r = metrics.evaluate(scored, "label", "prediction").first()
    assert r["accuracy"] >= (0.6 if model == "naive_bayes" else 0.85)
    scored.unpersist()


def test_cross_validation_beats_the_baseline(learnable):
    runs = evaluate.cross_validate(learnable, "logistic_regression", ["a", "b"], "label", "id", k=4, maxIter=10).toPandas()
    assert len(runs) == 4 and runs[["tp", "tn", "fp", "fn"]].to_numpy().sum() == 400
    assert (runs["f1"] > runs["baseline_f1"]).all()


def test_gaussian_bayes_equals_mllib(learnable):
    split = hash_split(learnable, "id")
    train, test = split.where("split = 'train'"), split.where("split = 'test'")
    own = models.gaussian_bayes(train, test, "label", ["a", "b"]).select("id", "prediction")
    lib = models.with_scores(models.fit("gaussian_naive_bayes", train, ["a", "b"], "label", scale=False), test)
    both = own.join(lib.select("id", F.col("prediction").cast("int").alias("p")), "id")
    assert both.where("prediction <> p").count() == 0


def test_reconstruction_detector_finds_shifted_rows(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=600)
    y = (np.arange(600) % 5 == 0).astype(int)
    frame = pd.DataFrame({"id": np.arange(600), "label": y, "a": a, "b": 2 * a + rng.normal(scale=0.05, size=600) + 4 * y})
    r = evaluate.reconstruction_holdout(spark.createDataFrame(frame), ["a", "b"], "label", "id", components=1).first()
    assert r["f1"] > 0.9


def test_exact_ranks_for_groups_of_every_size(spark):
    """All differences positive: p = 2 / 2^n, whatever n."""
    rows = [(n, float(i + 1), 0.0) for n in (3, 5, 10, 12, 13, 26, 60) for i in range(n)]
    got = signed_rank_test(spark.createDataFrame(rows, "n int, x double, y double").withColumnRenamed("n", "g"), ["g"], "x", "y").collect()
    assert {r["g"]: r["p_value"] for r in got} == {n: 2.0 ** (1 - n) for n in (3, 5, 10, 12, 13, 26, 60)}


def folded(doubled):
    """Share of all sign patterns per doubled rank sum, by plain numpy."""
    shares = np.ones(1)
    for r in doubled:
        wide = np.zeros(len(shares) + r)
        wide[:len(shares)] += shares / 2
        wide[r:] += shares / 2
        shares = wide
    return shares


@pytest.mark.parametrize("seed, n, digits", [(1, 66, 9), (3, 120, 1), (4, 500, 2), (6, 90, 0)])
def test_large_groups_equal_the_folded_distribution(spark, seed, n, digits):
    """With and without ties, one group beside small ones, and both the tails and the whole distribution."""
    from tidewatch.operators.ranktest import null_shares

    rng = np.random.default_rng(seed)
    d = np.round(rng.normal(0.1, 1, n), digits)
    rows = [("large", float(x), 0.0) for x in d] + [("small", float(i + 1), 0.0) for i in range(6)] + [(None, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    d = d[np.abs(d) > 1e-8]
    ranks = pd.Series(np.abs(d)).rank().to_numpy()
    shares = folded((2 * ranks).astype(int))
    w = min(ranks[d > 0].sum(), ranks[d < 0].sum())
    at = np.arange(len(shares))
    p = shares[np.minimum(at, len(shares) - 1 - at) <= 2 * w].sum()
    got = {r["g"]: r for r in signed_rank_test(df, ["g"], "x", "y").collect()}
    assert got["large"]["n"] == len(d) and got["large"]["statistic"] == w and abs(got["large"]["p_value"] - p) < 1e-11
    assert got["small"]["p_value"] == 2 ** -5 and got[None]["p_value"] == 1.0
    alone = signed_rank_test(df.where("g = 'large'"), [], "x", "y").first()
    assert abs(alone["p_value"] - p) < 1e-11
    if n <= 120:
        table = null_shares(average_ranks(differences(df, "x", "y", ["g"]), ["g"]), ["g"]).where("g = 'large'").collect()
        assert max(abs(r["share"] - shares[r["doubled"]]) for r in table) < 1e-14
        assert {r["doubled"] for r in table} >= set(np.flatnonzero(shares > 1e-13).tolist()) and len({r["doubled"] for r in table}) == len(table)


def test_one_group_with_a_third_of_all_pairs(spark):
    """50,000 pairs of one group: exact, without a row or task that holds them."""
    n = 50_000
    df = spark.range(3 * n).select(F.when(F.col("id") < n, 0).otherwise(F.col("id") % 49_999 + 1).alias("g"),
                                   (F.sin(F.col("id") * 12.9898) * 43758.5453 % 1 + F.lit(0.003)).alias("x"), F.lit(0.0).alias("y"))
    exact = signed_rank_test(df, ["g"], "x", "y").where("g = 0").first()
    normal = signed_rank_test(df, ["g"], "x", "y", method="normal").where("g = 0").first()
    assert exact["n"] == n and abs(exact["p_value"] - normal["p_value"]) < 1e-5 and 0 < exact["p_value"] < 1


def test_nan_differences_are_no_pairs(spark):
    nan = float("nan")
    rows = [(float(i), 0.0) for i in range(1, 9)] + [(nan, 0.0), (1.0, nan), (None, 1.0)]
    r = signed_rank_test(spark.createDataFrame(rows, "x double, y double"), [], "x", "y").first()
    assert (r["n"], r["w_plus"], r["p_value"], r["mean_difference"]) == (8, 36.0, 0.0078125, 4.5)


def test_nan_readings(spark):
    from tidewatch.functions.scalar import route
    from tidewatch.operators import cleaning, profile, scaling

    nan = float("nan")
    df = spark.createDataFrame([(1, 1.0, 0), (2, 2.0, 0), (3, nan, 0), (4, 3.0, 1), (5, None, 0)], "id int, x double, label int")
    assert [r["label"] for r in cleaning.wavelet_label(df, ["x"], "label", 2.0).orderBy("id").collect()] == [0, 0, 0, 1, 0]
    assert cleaning.remove_outliers(df, ["x"]).count() == cleaning.remove_outliers_at_once(df, ["x"]).count() == 5
    assert {r["bin"]: r["n"] for r in profile.histogram(df, ["x"], 2).collect()} == {0: 1, 1: 2}
    assert [r["x"] for r in scaling.min_max(df, ["x"]).orderBy("id").collect()] == [0.0, 0.5, None, 1.0, None]
    assert [r["r"] for r in df.select(route("x").alias("r"), "id").orderBy("id").collect()] == ["anomaly", "anomaly", "uncertain", "anomaly", None]


def test_class_weights_of_three_classes(spark):
    from tidewatch.operators.models import with_class_weights

    rows = spark.createDataFrame([(1,), (2,), (2,), (2,), (3,), (3,)], "label int")
    got = {r["label"]: round(r["class_weight"], 3) for r in with_class_weights(rows, "label").collect()}
    assert got == {1: 2.0, 2: 0.667, 3: 1.0}


def test_text_ids_oversample(spark):
    from tidewatch.operators.balance import smote
    from tidewatch.operators.neighbors import nearest

    rows = [(f"id-{i:03}", [float(i), 1.0], int(i < 4)) for i in range(20)] + [("id-none", None, 0), ("id-nan", [float("nan"), 1.0], 0)]
    df = spark.createDataFrame(rows, "id string, v array<double>, label int")
    made = smote(df.where("id not in ('id-none', 'id-nan')"), "label", "id", "v", k=2).where("synthetic").collect()
    assert len(made) == 12 and all(isinstance(r["id"], str) and 0 <= r["v"][0] <= 3 for r in made)
    near = nearest(df, df, 1, "id", "id", "v", exclude_self=True).collect()
    assert len(near) == 20 and not {"id-none", "id-nan"} & {r["query_id"] for r in near}


def test_standing_intervals_are_found_by_many_tasks(spark, monkeypatch):
    """The intervals of all groups are ruled out in as many tasks as a shuffle has, not in one."""
    from tidewatch.operators import ranktest

    seen = []
    arrow = ranktest._arrow

    def watched(df, by, fn, fields):
        if fn is ranktest._standing:
            seen.append(df.rdd.getNumPartitions())
        return arrow(df, by, fn, fields)

    monkeypatch.setattr(ranktest, "_arrow", watched)
    monkeypatch.setattr(ranktest, "_tasks", lambda df: 7)
    rows = [(g, float(i + 1), 0.0) for g in range(20) for i in range(70)]
    signed_rank_test(spark.createDataFrame(rows, "g int, x double, y double"), ["g"], "x", "y").collect()
    assert seen == [7]


def test_shares_above_a_limit_equal_the_folded_ones(spark):
    """Only shares above the limit come out, all of them, also where frequencies come in several lots."""
    from tidewatch.operators import ranktest

    d = np.round(np.random.default_rng(5).normal(0.1, 1, 1100), 3)
    df = spark.createDataFrame([(0, float(x), 0.0) for x in d], "g int, x double, y double")
    shares = folded((2 * pd.Series(np.abs(d[np.abs(d) > 1e-8])).rank()).astype(int))
    want = np.flatnonzero(shares > 1e-6)
    for waves in (ranktest.WAVES, 32):
        ranktest.WAVES, kept = waves, ranktest.WAVES
        got = ranktest.null_shares(average_ranks(differences(df, "x", "y", ["g"]), ["g"]), ["g"], 1e-6).toPandas().sort_values("doubled")
        ranktest.WAVES = kept
        assert got["doubled"].tolist() == want.tolist() and np.abs(got["share"] - shares[want]).max() < 1e-15


def test_small_shares_of_middling_groups_are_listed(spark):
    """Of 100 ranks every reachable sum has its share, down to 2 ** -100."""
    from tidewatch.operators.ranktest import null_shares

    df = spark.createDataFrame([(0, float(i + 1), 0.0) for i in range(100)], "g int, x double, y double")
    got = {r["doubled"]: r["share"] for r in null_shares(average_ranks(differences(df, "x", "y", ["g"]), ["g"]), ["g"]).collect()}
    assert sorted(got) == list(range(0, 10101, 2)) and got[0] == 2.0 ** -100


@pytest.mark.parametrize("digits, waves", [(3, None), (3, 32), (0, None)])
def test_all_sums_of_large_groups_are_listed(spark, monkeypatch, digits, waves):
    """Of 1,100 ranks every reachable sum has its row, whatever its share; with many ties most sums are reached by no pattern."""
    from tidewatch.operators import ranktest

    if waves:
        monkeypatch.setattr(ranktest, "WAVES", waves)
    monkeypatch.setattr(ranktest, "SPAN", 10_000)
    d = np.round(np.random.default_rng(7).normal(0.1, 1, 1100), digits)
    df = spark.createDataFrame([(g, float(x), 0.0) for g in (0, None) for x in d] + [(1, 2.0, 1.0)], "g int, x double, y double")
    d = np.abs(d[np.abs(d) > 1e-8])
    if len(d) <= ranktest.LISTED_RANKS:
        monkeypatch.setattr(ranktest, "LISTED_RANKS", 64)
    doubled = (2 * pd.Series(d).rank()).astype(int)
    shares, reached = folded(doubled), np.zeros(doubled.sum() + 1, bool)
    reached[0] = True
    for r in doubled:
        reached[r:] |= reached[:len(reached) - r].copy()
    got = ranktest.null_shares(average_ranks(differences(df, "x", "y", ["g"]), ["g"]), ["g"]).toPandas().sort_values("doubled")
    want = np.flatnonzero(reached)
    assert len(want) < len(reached) and len(got) == 2 * len(want) + 2
    for part in (got[got["g"] == 0], got[got["g"].isna()]):
        assert part["doubled"].tolist() == want.tolist() and np.abs(part["share"] - shares[want]).max() < 1e-14 and part["share"].min() >= 0


def test_daily_null_distribution_lists_small_shares(spark, tmp_path):
    """25 readings of one type and day: all 326 sums, down to a share of 2 ** -25."""
    from __spark_entry__ import queries

    rows = [(i, 7, "view", float(100 + 2 * i), '{"k": 1}') for i in range(25)]
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, value double, props string")
    df.withColumn("ts", F.expr("TIMESTAMP_NTZ'2024-01-03 05:00:00'")).write.parquet(f"{tmp_path}/events.parquet")
    got = {r["doubled"]: r["share"] for r in queries()["ag31_daily_null_distribution"](spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(0, 651, 2)) and got[0] == round(2.0 ** -25, 9)


def test_means_do_not_depend_on_the_order_of_rows(spark):
    """0.1 + 0.2 - 0.3 is no zero in doubles, in any order; a mean of 32 readings may lie half way between two rounded ones."""
    half = [0.01] * 3 + [-0.07] * 5 + [0.13, -0.29, 3.3, 7.77, -1.1] + [0.2] * 19
    assert round(sum(half) * 100) % 2 == 1 and len(half) == 32
    rows = [(g, x) for g in range(40) for x in np.random.default_rng(g).permutation([0.1, 0.2, -0.3] if g < 20 else half).tolist()]
    df = spark.createDataFrame(rows + [(40, 1e20), (40, 1.0), (41, 9e15), (41, 9e15), (42, 1e-8 * 1.5), (43, float("inf"))], "g int, x double").repartition(5)
    got = {r["g"]: r for r in signed_rank_test(df.withColumn("y", F.lit(0.0)), ["g"], "x", "y", method="normal").collect()}
    assert {(got[g]["mean_difference"], got[g]["direction"]) for g in range(20)} == {(0.0, "no_difference")}
    assert {got[g]["mean_difference"] for g in range(20, 40)} == {round(sum(half) * 100) / 3200}
    assert [got[g]["mean_difference"] for g in (40, 41, 42, 43)] == [5e19, 9e15, 1.5e-8, float("inf")]
