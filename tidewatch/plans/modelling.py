"""Fit, score and evaluate jobs.

A query returns rows tested by class, the random baseline, shares and counts along the protocol, whether the measures agree with
their counts, and facts that only a fit can meet: its F1 is above the random baseline's, the gradient of a linear model has
vanished, a tree's root split and Bayes predictions are those of the SQL twin.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.portable import uniform
from ..functions.scalar import positive_probability
from ..operators import evaluate, fits, metrics, models
from ..operators.neighbors import knn_classify
from ..operators.reports import flat_summary, pick_candidate, tuning_scores
from ..operators.splits import hash_split
from ..shared import run_dir, written
from ..sources.writers import write_scores
from .lookups import KNN
from .registry import query
from .views import REGIME, events, regime, rounded, summaries, u_sql, vectors, with_events, with_summary, with_vectors

FEATURES = ["value", "k", "hr", "signal"]
FOREST = {"numTrees": 100}
#: A reading that leans towards the label, by a hash of its own: the splits' seeds must not tell anything about it.
SIGNAL_SQL = f"(0.6::DOUBLE * {u_sql('signal', 'event_id')} + 0.4::DOUBLE * label)"


def labelled(spark, sf):
    return events(spark, sf).select("event_id", "label", "value", "k", "hr", (F.lit(0.6) * uniform("signal", "event_id") + F.lit(0.4) * F.col("label")).alias("signal"), "ts")


def portable(runs, *keys):
    """Of run metrics what doesn't depend on the engine, whether every measure follows from its counts, and whether anything was learnt."""
    n = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    f1 = F.coalesce(F.try_divide(F.lit(2.0) * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    fits = (F.abs(F.col("accuracy") - (F.col("tp") + F.col("tn")) / n) < 1e-9) & (F.abs(F.col("f1") - f1) < 1e-9)
    if "threshold" in runs.columns:
        fits = fits & F.col("threshold").isNotNull() & F.col("validation_f1").between(0, 1)
    still = [(F.col("gradient") < 1e-6).alias("stationary")] if "gradient" in runs.columns else []
    return runs.select(*keys, (F.col("tp") + F.col("fn")).alias("positives"), (F.col("tn") + F.col("fp")).alias("negatives"),
                       F.round("baseline_f1", 6).alias("baseline_f1"), fits.alias("consistent"), (F.col("f1") > F.col("baseline_f1")).alias("beats_baseline"), *still)


#: Rows by seeded order within their class, for folds and hold-outs.
ORDERED = """o AS (SELECT *, row_number() OVER (PARTITION BY sd, label ORDER BY md5(sd || ':' || event_id), event_id) AS rn,
 count(*) OVER (PARTITION BY sd, label) AS nc FROM {rows})"""
HELD = """c AS (SELECT *, floor(nc * {test} + 0.5) AS nt FROM o),
s AS (SELECT *, CASE WHEN rn <= nt THEN 'test' WHEN rn <= nt + floor((nc - nt) * {validation} + 0.5) THEN 'validation' ELSE 'train' END AS split FROM c)"""
SPLIT = f"h AS (SELECT *, {SIGNAL_SQL} AS signal, {u_sql('1234', 'event_id')} < 0.8 AS train FROM e)"


def baseline(keys: str, rows: str, linear: bool = True) -> str:
    """Rows by class and F1 of a random guess: ``rows`` gives the keys, event_id, label, p (its rate) and bs (its seed)."""
    still = ", true AS stationary" if linear else ""
    return f"""SELECT {keys}, CAST(sum(label) AS BIGINT) AS positives, CAST(sum(1 - label) AS BIGINT) AS negatives,
 round(coalesce(2.0::DOUBLE * sum(label * g) / nullif(sum(label) + sum(g), 0), 0.0::DOUBLE), 6) AS baseline_f1, true AS consistent, true AS beats_baseline{still}
 FROM (SELECT *, CAST((CAST('0x' || substr(md5(bs || ':' || event_id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE) < p AS INTEGER) AS g FROM ({rows})) GROUP BY {keys}"""


FIXED, FIXED_LINEAR = (with_events(baseline("run, seed", "SELECT 1 AS run, 42 AS seed, event_id, label, (SELECT avg(label) FROM h WHERE train) AS p, 20043 AS bs "
                                            "FROM h WHERE NOT train", linear), SPLIT) for linear in (False, True))


def _fit_and_measure(spark, sf, model, **settings):
    split = hash_split(labelled(spark, sf), "event_id")
    run = evaluate.fixed_split(split.where("split = 'train'"), split.where("split = 'test'"), model, FEATURES, "label", "event_id", **settings)
    return portable(run, "run", "seed")


@query("ml01_logistic_regression", FIXED_LINEAR)
def logistic_regression(spark, sf):
    return _fit_and_measure(spark, sf, "logistic_regression")


@query("ml02_random_forest", FIXED)
def random_forest(spark, sf):
    return _fit_and_measure(spark, sf, "random_forest")


@query("ml03_linear_svm", FIXED_LINEAR)
def linear_svm(spark, sf):
    return _fit_and_measure(spark, sf, "svm")


@query("ml04_decision_tree", FIXED)
def decision_tree(spark, sf):
    return _fit_and_measure(spark, sf, "decision_tree")


#: Cuts tried by the root split and its SQL twin.
CUTS = {"value": [10.0 * i for i in range(1, 32)], "k": [float(i) for i in range(9)], "hr": [float(i) for i in range(23)], "signal": [i / 20 for i in range(1, 20)]}
_GINI = "(1 - power({a} / ({b})::DOUBLE, 2) - power(({b} - {a}) / ({b})::DOUBLE, 2))"


@query("ml04_root_split", with_events(f"""
SELECT feature, cut, round(gain, 9) AS gain, n AS rows, nl AS left_rows, a AS positives, al AS left_positives FROM (
 SELECT *, {_GINI.format(a='a', b='n')} - nl / n::DOUBLE * {_GINI.format(a='al', b='nl')} - (n - nl) / n::DOUBLE * {_GINI.format(a='(a - al)', b='(n - nl)')} AS gain FROM (
 SELECT f, feature, cut, count(*) AS n, count(*) FILTER (x <= cut) AS nl, CAST(sum(label) AS BIGINT) AS a, CAST(coalesce(sum(label) FILTER (x <= cut), 0) AS BIGINT) AS al
 FROM (""" + " UNION ALL ".join(f"SELECT {j} AS f, '{f}' AS feature, {f}::DOUBLE AS x, label, unnest({c}) AS cut FROM h WHERE train" for j, (f, c) in enumerate(CUTS.items()))
    + ") GROUP BY ALL) WHERE nl > 0 AND nl < n) ORDER BY round(gain, 12) DESC, f, cut LIMIT 1", SPLIT))
def root_split(spark, sf):
    train = hash_split(labelled(spark, sf), "event_id").where("split = 'train'").withColumn("w", F.lit(1.0))
    tree = fits.fit_trees(train, list(CUTS), "label", "event_id", ["w"], depth=1, edges=list(CUTS.values()))
    f = int(tree.feature[0, 0])
    row = (list(CUTS)[f], float(tree.edges[f][tree.cut[0, 0]]), round(float(tree.gain[0, 0]), 9), int(tree.rows[0, 0]), int(tree.rows[0, 1]),
           round(float(tree.share[0, 0] * tree.rows[0, 0])), round(float(tree.share[0, 1] * tree.rows[0, 1])))
    return spark.createDataFrame([row], "feature string, cut double, gain double, rows long, left_rows long, positives long, left_positives long")


@query("ml05_nearest_neighbour_classifier", with_vectors("""
SELECT query_id, arg_min(ny, struct_pack(a := -n, b := ny)) AS prediction FROM (SELECT query_id, ny, count(*) AS n FROM nn WHERE rank <= 5 GROUP BY query_id, ny)
GROUP BY query_id""", f"h AS (SELECT *, {u_sql('1234', 'vec_id')} < 0.8 AS train FROM v)",
    KNN.format(on="NOT a.train AND b.train").replace("FROM v a JOIN v b", "FROM h a JOIN h b")))
def nearest_neighbour(spark, sf):
    h = hash_split(vectors(spark, sf), "vec_id")
    return knn_classify(h.where("split = 'test'"), h.where("split = 'train'"), 5, "vec_id", "vec_id", "v", "y")


@query("ml06_multinomial_naive_bayes", FIXED.replace(", true AS beats_baseline", ""))
def naive_bayes(spark, sf):
    """These readings are no counts, and the model finds no anomaly in them; ``ml06_multinomial_predictions`` checks every prediction."""
    return _fit_and_measure(spark, sf, "naive_bayes").drop("beats_baseline")


@query("ml06_gaussian_naive_bayes", FIXED)
def gaussian_naive_bayes(spark, sf):
    return _fit_and_measure(spark, sf, "gaussian_naive_bayes")


@query("ml06_multinomial_predictions", with_events("""SELECT event_id, CAST(p1 > p0 AS INTEGER) AS prediction FROM (SELECT event_id, """ + ", ".join(
    f"(SELECT ln(n + 1) FROM st WHERE label = {c}) + " + " + ".join(f"greatest(h.{f}::DOUBLE - (SELECT min({f}) FROM h WHERE train)::DOUBLE, 0) * "
    f"(SELECT ln(t_{f} + 1) - ln({' + '.join(f't_{g}' for g in FEATURES)} + {len(FEATURES)}) FROM st WHERE label = {c})" for f in FEATURES) + f" AS p{c}" for c in (0, 1)) + " FROM h WHERE NOT train)",
    SPLIT, "st AS (SELECT label, count(*) AS n, " + ", ".join(f"sum({f}::DOUBLE - (SELECT min({f}) FROM h WHERE train)::DOUBLE) AS t_{f}" for f in FEATURES) + " FROM h WHERE train GROUP BY label)"))
def multinomial_predictions(spark, sf):
    h = hash_split(labelled(spark, sf), "event_id").withColumns({"w": (F.col("split") == "train").cast("double"), "fit": F.lit(0)})
    fitted = fits.fit_bayes(h, FEATURES, "label", ["w"], "multinomial")
    scored = fitted.score(h.where("split = 'test'").select("event_id", "fit", *FEATURES), "fit")
    return scored.select("event_id", (F.col("score") > 0.5).cast("int").alias("prediction"))


def _log_density() -> str:
    gaps = " - ".join(f"ln(2 * pi() * v_{f}) / 2 - (h.{f} - m_{f}) * (h.{f} - m_{f}) / (2 * v_{f})" for f in FEATURES)
    return f"ln(prior) - {gaps}"


@query("ml06_gaussian_naive_bayes_sql", with_events(f"""
SELECT event_id, CAST(arg_min(c, struct_pack(a := -d, b := c)) AS INTEGER) AS prediction FROM (SELECT h.event_id, st.label AS c, {_log_density()} AS d
 FROM h, st WHERE NOT h.train) GROUP BY event_id""",
    f"h AS (SELECT *, {SIGNAL_SQL} AS signal, {u_sql('1234', 'event_id')} < 0.8 AS train FROM e)",
    "st AS (SELECT label, count(*) / (SELECT count(*) FROM h WHERE train)::DOUBLE AS prior, " + ", ".join(
        f"avg({f}) AS m_{f}, var_pop({f}) AS v_{f}" for f in FEATURES) + " FROM h WHERE train GROUP BY label)"))
def gaussian_bayes_sql(spark, sf):
    h = hash_split(labelled(spark, sf), "event_id")
    out = models.gaussian_bayes(h.where("split = 'train'"), h.where("split = 'test'"), "label", FEATURES)
    return out.select("event_id", "prediction")


@query("ml07_model_saved_and_reloaded", with_events("""
SELECT CAST(sum(label) AS BIGINT) AS positives, CAST(sum(1 - label) AS BIGINT) AS negatives, 0::BIGINT AS scored_otherwise FROM h WHERE NOT train""", SPLIT))
def pipeline_round_trip(spark, sf):
    split = hash_split(labelled(spark, sf), "event_id")
    test = split.where("split = 'test'")
    path = run_dir(spark, "model")
    fitted = models.fit("random_forest", split.where("split = 'train'"), FEATURES, "label", **FOREST)
    models.save(fitted, path, FEATURES, "label")
    both = models.with_scores(models.load(path), test, "p1").join(
        models.with_scores(fitted, test, "p2").select("event_id", "p2", F.col("prediction").alias("before")), "event_id")
    return both.agg(F.sum("label").cast("bigint").alias("positives"), F.sum(1 - F.col("label")).cast("bigint").alias("negatives"),
                    F.count_if((F.col("p1") != F.col("p2")) | (F.col("prediction") != F.col("before"))).alias("scored_otherwise"))


@query("src08_saved_model_load", with_events("SELECT label, count(*) AS n, count(*) AS scored FROM e GROUP BY label"))
def saved_pipeline(spark, sf):
    e = labelled(spark, sf)
    path = run_dir(spark, "pipeline")
    models.save(models.fit("decision_tree", hash_split(e, "event_id").where("split = 'train'"), FEATURES, "label"), path, FEATURES, "label")
    scored = models.with_scores(models.load(path), e, "p1")
    return scored.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p1").between(0, 1) & F.col("prediction").isin(0.0, 1.0)).alias("scored"))


@query("prj11_positive_probability", with_events("SELECT event_id, true AS in_range, true AS agrees FROM h WHERE NOT train", SPLIT))
def probability_of_one(spark, sf):
    split = hash_split(labelled(spark, sf), "event_id")
    fitted = models.fit("logistic_regression", split.where("split = 'train'"), FEATURES, "label")
    p = positive_probability("probability")
    return fitted.transform(split.where("split = 'test'")).select("event_id", p.between(0, 1).alias("in_range"), ((p > 0.5) == (F.col("prediction") == 1)).alias("agrees"))


@query("ml08_cross_validation", with_events(baseline("run, seed", """
SELECT f + 1 AS run, 42 AS seed, event_id, label, CAST(10043 + f AS VARCHAR) AS bs, (sum(label) OVER () - sum(label) OVER (PARTITION BY f)) / (count(*) OVER () - count(*) OVER (PARTITION BY f))::DOUBLE AS p
FROM (SELECT *, CAST((rn - 1) % 5 AS INTEGER) AS f FROM o)"""), ORDERED.format(rows="(SELECT *, '42' AS sd FROM e)")))
def cross_validation(spark, sf):
    return portable(evaluate.cross_validate(labelled(spark, sf), "logistic_regression", FEATURES, "label", "event_id", k=5), "run", "seed")


def holdout_sql(seeds: str, rate: str = "avg(label) FILTER (split = 'train') OVER (PARTITION BY sd)", linear: bool = True) -> str:
    return with_events(baseline("run, seed", f"SELECT * FROM (SELECT run, CAST(sd AS INTEGER) AS seed, event_id, label, split, CAST(CAST(sd AS INTEGER) + 20000 + run AS VARCHAR) AS bs, {rate} AS p FROM s) WHERE split = 'test'", linear),
                       ORDERED.format(rows=f"(SELECT e.*, sd, run FROM e, (VALUES {seeds}) t(sd, run))"), HELD.format(test=0.2, validation=0.2))


@query("ml09_repeated_holdout", holdout_sql("('42', 1), ('52', 2), ('62', 3)"))
def repeated_holdout(spark, sf):
    return portable(evaluate.repeated_holdout(labelled(spark, sf), "logistic_regression", FEATURES, "label", "event_id", weighted=True), "run", "seed")


SHARES = f"""r AS (SELECT *, {REGIME} AS regime FROM e), d AS (SELECT * FROM (VALUES ('standard', 'optimized'), ('optimized', 'standard')) t(train_source, test_source)),
sh AS (SELECT regime, avg(label) AS share FROM r GROUP BY regime)"""


@query("ml10_generalization", with_events("SELECT * FROM (" + baseline(
    "train_source, test_source, seed, positive_rate_train_raw, positive_rate_train_after_smote, positive_rate_test", """
SELECT train_source, test_source, round(a.share, 6) AS positive_rate_train_raw, 0.5::DOUBLE AS positive_rate_train_after_smote, round(b.share, 6) AS positive_rate_test,
 event_id, label, 0.5::DOUBLE AS p, CAST(20001 + seed AS VARCHAR) AS bs, seed FROM d JOIN sh a ON a.regime = train_source JOIN sh b ON b.regime = test_source
 JOIN r ON r.regime = test_source, (SELECT unnest([42, 52, 62, 72, 82]) AS seed)""") + ")", SHARES))
def generalization(spark, sf):
    e = labelled(spark, sf).withColumn("regime", regime())
    a, b = e.where("regime = 'standard'").drop("regime"), e.where("regime = 'optimized'").drop("regime")
    runs = evaluate.generalize(a, b, "logistic_regression", FEATURES, "label", "event_id", ("standard", "optimized"))
    rates = ("positive_rate_train_raw", "positive_rate_train_after_smote", "positive_rate_test")
    return portable(runs, "train_source", "test_source", "seed", *[F.round(c, 6).alias(c) for c in rates])


@query("ml11_fixed_split", FIXED_LINEAR)
def fixed_split(spark, sf):
    return _fit_and_measure(spark, sf, "logistic_regression")


@query("ml12_reconstruction_detector", holdout_sql("('42', 1)", linear=False))
def reconstruction(spark, sf):
    return portable(evaluate.reconstruction_holdout(labelled(spark, sf), FEATURES, "label", "event_id", components=2), "run", "seed")


@query("ml12_low_rank_basis", with_events("""
SELECT round((1 + abs(corr(value, signal))) / 2, 6) AS captured, round(avg(e), 6) AS mean_error FROM (SELECT value, signal, power((value - mv) / sv - g * (signal - ms) / ss, 2) / 4 AS e FROM h,
 (SELECT avg(value) AS mv, stddev_samp(value) AS sv, avg(signal) AS ms, stddev_samp(signal) AS ss, sign(corr(value, signal)) AS g FROM h))""", SPLIT))
def low_rank_basis(spark, sf):
    """Of two standardised readings the first axis lies on a diagonal: its variance and every row's gap are known."""
    e = labelled(spark, sf)
    basis = fits.fit_basis(e, ["value", "signal"], 1)
    share = float(basis.variance.sum() / basis.total)
    return basis.error(e.select("value", "signal")).agg(F.round(F.lit(share), 6).alias("captured"), F.round(F.avg("error"), 6).alias("mean_error"))


@query("ml13_neural_network", holdout_sql("('42', 1)", "0.5::DOUBLE", False))
def neural_network(spark, sf):
    return portable(evaluate.balanced_network(labelled(spark, sf), FEATURES, "label", "event_id"), "run", "seed")


@query("ml14_candidate_search", with_events("""
SELECT 'logistic_regression' AS model, tuning_profile, 3::BIGINT AS candidates, CAST(sum(floor(n * 0.2 + 0.5)) FILTER (label = 1) AS BIGINT) AS positives,
 CAST(sum(floor(n * 0.2 + 0.5)) FILTER (label = 0) AS BIGINT) AS negatives, true AS beats_baseline FROM (
 SELECT """ + REGIME + """ AS regime, label, count(*) AS n FROM e GROUP BY 1, 2), (SELECT unnest(['plain', 'ridge', 'strong ridge']) AS tuning_profile) GROUP BY tuning_profile"""))
def candidate_search(spark, sf):
    runs = written(candidate_runs(spark, sf), "candidates")
    return runs.groupBy("model", "tuning_profile").agg(
        F.lit(3).cast("bigint").alias("candidates"), F.sum(F.col("tp") + F.col("fn")).alias("positives"), F.sum(F.col("tn") + F.col("fp")).alias("negatives"),
        F.min(F.col("test_f1") > F.col("baseline_f1")).alias("beats_baseline"))


def candidate_runs(spark, sf):
    e = labelled(spark, sf).withColumn("regime", regime())
    data = {r: e.where(F.col("regime") == r).drop("regime") for r in ("standard", "optimized")}
    tried = {"plain": ("logistic_regression", {}), "ridge": ("logistic_regression", {"regParam": 0.1}), "strong ridge": ("logistic_regression", {"regParam": 1.0})}
    return evaluate.search_candidates(data, tried, FEATURES, "label", "event_id")


@query("ml14_candidate_chosen", "SELECT 'logistic_regression' AS model, 3::BIGINT AS candidates, true AS best_by_validation")
def candidate_chosen(spark, sf):
    scores = written(tuning_scores(candidate_runs(spark, sf), ["model", "tuning_profile", "place"]), "candidates")
    best = scores.groupBy("model").agg(F.count(F.lit(1)).alias("candidates"), F.max("mean_validation_f1").alias("highest"))
    return pick_candidate(scores, "model", "place").join(best, "model").select(
        "model", "candidates", (F.col("mean_validation_f1") == F.col("highest")).alias("best_by_validation"))


FLAT = """SELECT dataset, model, family, 'stratified' AS evaluation_strategy, accuracy_mean, accuracy_std, precision_mean, precision_std, recall_mean, recall_std,
 f1_mean, f1_std, baseline_f1_mean, 0.0::DOUBLE AS baseline_f1_std, 1.0::DOUBLE AS p_value, false AS significant, 'no_difference' AS direction,
 0.01::DOUBLE AS learning_rate, 32 AS batch_size, 10 AS epochs, 'adam' AS optimizer, 'binary' AS loss_function, 'N/A' AS class_weight_mode,
 'default' AS tuning_profile, 'CPU' AS hardware FROM summary"""


@query("ml16_flat_summary", with_summary(FLAT))
def flat(spark, sf):
    s = summaries(spark, sf)
    own = [c for c in s.columns if c.endswith(("_mean", "_std")) and c != "baseline_f1_mean"]
    meta = F.struct(F.lit(0.01).alias("learning_rate"), F.lit(32).alias("batch_size"), F.lit(10).alias("epochs"), F.lit("adam").alias("optimizer"),
                    F.lit("binary").alias("loss_function"), F.lit(None).cast("string").alias("class_weight_mode"),
                    F.lit("default").alias("tuning_profile"), F.lit("CPU").alias("hardware"))
    payload = s.select(
        F.struct(F.col("dataset").alias("name")).alias("dataset"),
        F.struct(F.col("model").alias("name"), "family", meta.alias("metadata")).alias("model"),
        F.struct(F.lit("stratified").alias("strategy")).alias("protocol"), F.struct(*own).alias("summary"),
        F.struct(F.col("baseline_f1_mean").alias("f1_mean"), F.lit(0.0).alias("f1_std")).alias("baseline_summary"),
        F.struct(F.lit(1.0).alias("p_value"), F.lit(False).alias("significant"), F.lit("no_difference").alias("direction")).alias("statistical_test"))
    return flat_summary(payload)


@query("ml17_batch_scoring", with_events("SELECT label, count(*) AS n, count(*) AS scored FROM e GROUP BY label"))
def batch_scoring(spark, sf):
    e = labelled(spark, sf).drop("ts")
    fitted = models.fit("decision_tree", hash_split(e, "event_id").where("split = 'train'"), FEATURES, "label")
    scored = evaluate.batch_score(fitted, [e.where("label = 0"), e.where("label = 1").select(*reversed(e.columns))], "p1")
    return scored.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count("p1").alias("scored"))


@query("snk09_score_export", with_events("SELECT CAST(sum(label) AS BIGINT) AS positives, CAST(sum(1 - label) AS BIGINT) AS negatives FROM h WHERE NOT train", SPLIT))
def score_export(spark, sf):
    split = hash_split(labelled(spark, sf), "event_id")
    fitted = models.fit("decision_tree", split.where("split = 'train'"), FEATURES, "label")
    path = run_dir(spark, "scores")
    write_scores(models.with_scores(fitted, split.where("split = 'test'"), "p1"), path)
    back = metrics.confusion(spark.read.schema("label INT, prediction DOUBLE").json(path), "label", "prediction")
    return back.select((F.col("tp") + F.col("fn")).alias("positives"), (F.col("tn") + F.col("fp")).alias("negatives"))


@query("snk08_model_artifact", "SELECT 3::BIGINT AS n_features, 'label' AS label_col, true AS named")
def model_artifact(spark, sf):
    path = run_dir(spark, "artifact")
    features = ["value", "k", "hr"]
    models.save(models.fit("decision_tree", labelled(spark, sf), features, "label"), path, features, "label")
    note = spark.read.schema("model_path STRING, features ARRAY<STRING>, label_col STRING, features_col STRING").json(path + "_metadata")
    return note.select(F.size("features").cast("bigint").alias("n_features"), "label_col",
                       ((F.col("model_path") == path) & F.col("features_col").isNotNull()).alias("named"))


@query("ml18_experiment_suite", with_events("""SELECT dataset, model, CAST(count(*) AS BIGINT) AS runs, CAST(sum(positives) AS BIGINT) AS positives, CAST(sum(negatives) AS BIGINT) AS negatives,
 round(avg(baseline_f1), 5) AS baseline_f1_mean, round(stddev_pop(baseline_f1), 5) AS baseline_f1_std, CASE WHEN model <> 'naive_bayes' THEN true END AS beats_baseline FROM (""" + baseline("dataset, run", """
SELECT sd0 AS dataset, f + 1 AS run, event_id, label, CAST(10043 + f AS VARCHAR) AS bs,
 (sum(label) OVER (PARTITION BY sd0) - sum(label) OVER (PARTITION BY sd0, f)) / (count(*) OVER (PARTITION BY sd0) - count(*) OVER (PARTITION BY sd0, f))::DOUBLE AS p
FROM (SELECT *, CAST((rn - 1) % 5 AS INTEGER) AS f FROM (SELECT *, row_number() OVER (PARTITION BY sd0, label ORDER BY md5('42:' || event_id), event_id) AS rn
 FROM (SELECT *, """ + REGIME + """ AS sd0 FROM e)))""", False) + "), (SELECT unnest([" + ", ".join(f"'{m}'" for m in models.SETTINGS) + "]) AS model) GROUP BY dataset, model"))
def experiment_suite(spark, sf):
    e = labelled(spark, sf).withColumn("regime", regime())
    data = {r: e.where(F.col("regime") == r).drop("regime", "ts") for r in ("standard", "optimized")}
    # Fold metrics are a small results table; it is written once and summarised from there.
    done = written(evaluate.suite(data, {m: FOREST if m == "random_forest" else {} for m in models.SETTINGS}, FEATURES, "label", "event_id"), "suite")
    s = evaluate.summarize(done, ["dataset", "model", "family"])
    return s.select("dataset", "model", "runs", (F.col("tp_total") + F.col("fn_total")).alias("positives"), (F.col("tn_total") + F.col("fp_total")).alias("negatives"),
                    F.round("baseline_f1_mean", 5).alias("baseline_f1_mean"), F.round("baseline_f1_std", 5).alias("baseline_f1_std"),
                    F.when(F.col("model") != "naive_bayes", F.col("f1_mean") > F.col("baseline_f1_mean")).alias("beats_baseline"))


@query("ml19_pooled_holdout", with_events("SELECT * FROM (" + baseline("feature_count", """
SELECT feature_count, event_id, label, 0.5::DOUBLE AS p, '20043' AS bs FROM s, (VALUES (4), (5)) n(feature_count) WHERE split = 'test'""") + ")",
    ORDERED.format(rows="(SELECT *, '42' AS sd FROM e)"), HELD.format(test=0.3, validation=0.0)))
def pooled_holdout(spark, sf):
    e = labelled(spark, sf).withColumn("regime", regime())
    a, b = (e.where(F.col("regime") == r).drop("regime", "ts") for r in ("standard", "optimized"))
    return portable(evaluate.pooled_holdout(a, b, "logistic_regression", FEATURES, "label", "event_id"), "feature_count")
