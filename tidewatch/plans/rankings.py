"""Ranks, folds, interleaving, threshold choice, ordering, limits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.portable import order_key
from ..functions.scalar import route
from ..operators import profile, quality, reports
from ..operators.joins import last_per_key, top_rows
from ..operators.neighbors import nearest
from ..operators.ordered import ranked, with_range_bucket
from ..operators.ranktest import average_ranks
from ..operators.routing import SWEEP_ANOMALY, SWEEP_NORMAL, threshold_sweep
from ..operators.splits import shuffled, stratified_folds, stratified_holdout
from ..operators.thresholds import CLASSIFIER_GRID, pick_classifier_threshold, pick_error_threshold
from ..sources.replay import interleave, message_id
from ..sources.writers import union_ragged
from .aggregates import POLICY_COLUMNS, policy_sql, tuning_runs
from .lookups import KNN
from .registry import query
from .tables import REPLAY
from .views import (
    EPOCH_MS, ROUTE, baseline_runs, events, rounded, runs, summaries, table, u_sql, vectors, with_events,
    with_runs, with_summary, with_vectors,
)


@query("wn01_k_nearest", with_vectors("""
SELECT query_id, neighbor_id, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM nn WHERE rank <= 5""",
       KNN.format(on="a.vec_id <> b.vec_id")))
def k_nearest(spark, sf):
    v = vectors(spark, sf)
    return rounded(nearest(v, v, 5, "vec_id", "vec_id", "v", exclude_self=True))


@query("wn02_average_ranks", with_events("""
SELECT user_id, sz AS size, count(*) AS n, any_value(r) AS rank FROM (SELECT user_id, sz,
 rank() OVER (PARTITION BY user_id ORDER BY sz) + (count(*) OVER (PARTITION BY user_id, sz) - 1) / 2.0::DOUBLE AS r
 FROM (SELECT user_id, round(abs(value - k), 8) AS sz FROM e WHERE abs(value - k) > 1e-8)) GROUP BY 1, 2"""))
def average_rank(spark, sf):
    from ..operators.ranktest import differences

    out = average_ranks(differences(events(spark, sf), "value", "k", ["user_id"]), ["user_id"])
    return out.select("user_id", "size", "n", "rank")


RANKED = "r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || event_id), event_id) AS rk, count(*) OVER (PARTITION BY label) AS n FROM e)"


@query("wn03_stratified_folds", with_events("SELECT event_id, label, CAST((rk - 1) % 5 AS INTEGER) AS fold FROM r", RANKED))
def folds(spark, sf):
    return stratified_folds(events(spark, sf).select("event_id", "label"), "label", "event_id", 5)


@query("wn04_stratified_holdout", with_events("""
SELECT event_id, label, CASE WHEN rk <= nt THEN 'test' WHEN rk <= nt + floor((n - nt) * 0.2::DOUBLE + 0.5::DOUBLE) THEN 'validation' ELSE 'train' END AS split
FROM (SELECT *, floor(n * 0.2::DOUBLE + 0.5::DOUBLE) AS nt FROM r)""", RANKED))
def holdout(spark, sf):
    return stratified_holdout(events(spark, sf).select("event_id", "label"), "label", "event_id")


@query("wn05_keep_last_result", with_runs("""
SELECT dataset, model, arg_max(run, run) AS run, round(arg_max(f1, run), 6) AS f1 FROM runs GROUP BY dataset, model"""))
def keep_last(spark, sf):
    return rounded(last_per_key(runs(spark, sf).select("dataset", "model", "run", "f1"), ["dataset", "model"], "run"))


@query("wn06_best_per_dataset", with_summary("""
SELECT dataset, model, f1_mean FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY f1_mean DESC, recall_mean DESC,
 precision_mean DESC, model) AS r FROM summary) WHERE r = 1"""))
def best_dataset(spark, sf):
    return reports.best_per_dataset(summaries(spark, sf)).select("dataset", "model", "f1_mean")


@query("wn07_best_per_family", with_summary("""
SELECT dataset, family, model, f1_mean FROM (SELECT *, row_number() OVER (PARTITION BY dataset, family ORDER BY f1_mean DESC, model) AS r
 FROM summary) WHERE r = 1"""))
def best_family(spark, sf):
    return reports.best_per_family(summaries(spark, sf)).select("dataset", "family", "model", "f1_mean")


TOP = """t AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY f1_mean DESC, recall_mean DESC, precision_mean DESC, model) AS place
 FROM summary)"""


@query("wn08_leader_gaps", with_summary("""
SELECT a.dataset, a.model AS best_model, a.f1_mean AS best_score, b.model AS second_model, b.f1_mean AS second_score,
 round(a.f1_mean - b.f1_mean, 6) AS gap FROM t a JOIN t b USING (dataset) WHERE a.place = 1 AND b.place = 2""", TOP))
def leader_gaps(spark, sf):
    return rounded(reports.leader_gaps(summaries(spark, sf)))


@query("wn08_family_gaps", with_summary("""
SELECT dataset, family, model, f1_mean, max(f1_mean) OVER (PARTITION BY dataset) AS best_score,
 round(max(f1_mean) OVER (PARTITION BY dataset) - f1_mean, 6) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY dataset, family
 ORDER BY f1_mean DESC, model) AS r FROM summary) WHERE r = 1"""))
def family_gaps(spark, sf):
    return rounded(reports.family_gaps(summaries(spark, sf)))


@query("wn09_monotonic_time", with_events(f"""
SELECT event_type, count(*) AS records, count(*) FILTER (t < p) AS steps_back FROM (SELECT event_type, t,
 lag(t) OVER (PARTITION BY event_type ORDER BY event_id) AS p FROM (SELECT *, ts_us - CASE WHEN {u_sql('o', 'event_id')} < 0.1
 THEN 3600000000 ELSE 0 END AS t FROM e)) GROUP BY event_type"""))
def monotonic(spark, sf):
    from ..functions.portable import uniform

    late = F.when(uniform("o", "event_id") < 0.1, 3600000000).otherwise(0)
    e = events(spark, sf).select("event_id", "event_type", (F.col("ts_us") - late).alias("t"))
    return quality.monotonic_steps(e, "event_id", "t", ["event_type"])


@query("wn10_class_interleave", with_events("SELECT event_id, label, seq FROM o", REPLAY))
def class_interleave(spark, sf):
    return interleave(events(spark, sf).select("event_id", "label"), "event_id", F.col("label") == 1)


@query("wn11_sequential_message_ids", with_events("""
SELECT event_id, printf('msg-%08d', row_number() OVER (ORDER BY event_id)) AS message_id FROM e"""))
def sequential_ids(spark, sf):
    e = events(spark, sf).select("event_id")
    return ranked(with_range_bucket(e, "event_id"), [], ["event_id"], "seq").select("event_id", message_id().alias("message_id"))


def _d(x: str, y: str) -> str:
    return f"coalesce(({x})::DOUBLE / nullif(({y})::DOUBLE, 0), 0.0::DOUBLE)"


_P, _R = _d("tp", "tp + fp"), _d("tp", "tp + fn")
_F1 = _d(f"2.0::DOUBLE * {_P} * {_R}", f"{_P} + {_R}")
PICK = f"""m AS (SELECT *, {_P} AS precision, {_R} AS recall, {_F1} AS f1, {_d('fp + fn', 'tp + tn + fp + fn')} AS error_rate FROM (
 SELECT {{by}}, step, t, count(*) FILTER (s >= t AND label = 1) AS tp, count(*) FILTER (s < t AND label = 0) AS tn,
 count(*) FILTER (s >= t AND label = 0) AS fp, count(*) FILTER (s < t AND label = 1) AS fn FROM {{src}}, grid GROUP BY ALL)),
best AS (SELECT *, row_number() OVER (PARTITION BY {{by}} ORDER BY f1 DESC, precision DESC, recall DESC, error_rate, step) AS rn FROM m)"""
GRID = "grid AS (SELECT unnest([%s]) AS step, unnest([%s]) AS t)" % (
    ", ".join(str(i) for i in range(38)), ", ".join(f"{t!r}::DOUBLE" for t in [0.5, *CLASSIFIER_GRID]))


@query("wn12_classifier_threshold", with_events("""
SELECT event_type, t AS threshold, tp, tn, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM best WHERE rn = 1""",
    "lab AS (SELECT event_type, score AS s, CAST(k >= 50 AS INTEGER) AS label FROM e)", GRID, PICK.format(by="event_type", src="lab")))
def classifier_threshold(spark, sf):
    e = events(spark, sf).select("event_type", "score", (F.col("k") >= 50).cast("int").alias("label"))
    best = pick_classifier_threshold(e, "score", "label", ["event_type"])
    return best.select("event_type", "threshold", "tp", "tn", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("wn13_error_threshold", with_events("""
SELECT round(t, 6) AS threshold, tp, tn, fp, fn, round(f1, 6) AS f1 FROM best WHERE rn = 1""",
    "lab AS (SELECT 1 AS one, value AS s, label FROM e)",
    "lh AS (SELECT min(s) AS lo, max(s) AS hi FROM lab)",
    "grid AS (SELECT i AS step, CASE WHEN i = 40 THEN hi ELSE lo + i * ((hi - lo) / 40) END AS t FROM (SELECT unnest(range(41)) AS i), lh)",
    PICK.format(by="one", src="lab")))
def error_threshold(spark, sf):
    best = pick_error_threshold(events(spark, sf).select("value", "label"), "value", "label")
    return best.select(F.round("threshold", 6).alias("threshold"), "tp", "tn", "fp", "fn", F.round("f1", 6).alias("f1"))


SWEEP = "grid AS (SELECT a, n, true AS rv FROM (SELECT unnest([%s]) AS a), (SELECT unnest([%s]) AS n) WHERE n < a)" % (
    ", ".join(f"{a!r}::DOUBLE" for a in SWEEP_ANOMALY), ", ".join(f"{n!r}::DOUBLE" for n in SWEEP_NORMAL))
SWEPT = f"""pol AS (SELECT printf('route_uncertain_a%.2f_n%.2f', anomaly_threshold, normal_threshold) AS policy_name, {POLICY_COLUMNS}
 FROM ({policy_sql('a', 'n', 'rv')})),
b AS (SELECT * FROM pol WHERE anomaly_threshold = 0.8::DOUBLE AND normal_threshold = 0.2::DOUBLE),
dl AS (SELECT pol.*, pol.review_load_ratio - b.review_load_ratio AS d1, pol.effective_recall_with_review - b.effective_recall_with_review AS d2,
 pol.fpr_on_auto_alert - b.fpr_on_auto_alert AS d3, pol.precision_on_auto_alert - b.precision_on_auto_alert AS d4,
 abs(pol.anomaly_threshold - 0.8::DOUBLE) AS ag, abs(pol.normal_threshold - 0.2::DOUBLE) AS ng FROM pol, b),
best AS (SELECT policy_name AS chosen FROM dl ORDER BY CASE WHEN ag < 1e-9 AND d2 >= -0.10 AND d3 <= 0.01 AND d4 >= -0.01 THEN 0 ELSE 1 END,
 review_load_ratio, -effective_recall_with_review, fpr_on_auto_alert, -precision_on_auto_alert, ag, ng LIMIT 1)"""


@query("wn14_routing_sweep", with_events("""
SELECT dl.* EXCLUDE (d1, d2, d3, d4, ag, ng), round(d1, 5) AS delta_review_load_ratio, round(d2, 5) AS delta_effective_recall_with_review,
 round(d3, 5) AS delta_fpr_on_auto_alert, round(d4, 5) AS delta_precision_on_auto_alert, ag < 1e-9 AND ng < 1e-9 AS is_baseline,
 policy_name = chosen AS is_recommended FROM dl, best""", SWEEP, SWEPT))
def routing_sweep(spark, sf):
    out = rounded(threshold_sweep(events(spark, sf), "score", "label"))
    return out.withColumns({c: F.round(c, 5) for c in out.columns if c.startswith("delta_")})


@query("wn15_candidate_pick", with_runs("""
SELECT model, run, mean_validation_f1, mean_test_f1 FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY mean_validation_f1 DESC,
 mean_test_f1 DESC, run) AS r FROM (SELECT model, run, round(avg(r.f1), 6) AS mean_validation_f1, round(avg(b.f1), 6) AS mean_test_f1
 FROM runs r JOIN base b USING (dataset, model, run) GROUP BY model, run)) WHERE r = 1"""))
def candidate_pick(spark, sf):
    scores = rounded(reports.tuning_scores(tuning_runs(spark, sf), ["model", "run"]))
    return reports.pick_candidate(scores, "model", "run")


@query("wn16_replay_batches", with_events("""
SELECT batch, count(*) AS messages, CAST(sum(event_id) AS BIGINT) AS ids, round(sum(value), 4) AS total FROM (
 SELECT i * 10 // 5000 AS batch, event_id, value FROM (SELECT unnest(range(c * 3)) AS i, c FROM (SELECT count(*) AS c FROM e))
 JOIN (SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM e) ON pos = i % c
 WHERE i * 10 < (c * 30 // 1000) * 1000 AND i * 10 // 5000 < (c * 30 // 1000) // 5) GROUP BY batch"""))
def replay_batches(spark, sf):
    e = events(spark, sf).select("event_id", "value")
    n = e.count()
    reservoir = ranked(with_range_bucket(e, "event_id"), [], ["event_id"], "_r").withColumn("reservoir_row", F.col("_r") - 1)
    # Replay three times the table's length at one message per 10 ms in 5 s batches.
    plan = quality.replay_batches(spark, 10, 5, n * 30 // 1000, n)
    return plan.join(reservoir, "reservoir_row").groupBy("batch").agg(
        F.count(F.lit(1)).alias("messages"), F.sum("event_id").alias("ids"), F.round(F.sum("value"), 4).alias("total"))


@query("wn17_alert_timing", with_events(f"""
SELECT user_id, count(*) AS records, count(*) FILTER (route = 'anomaly') AS alerts, round(avg(sc - ts_s) * 1000, 2) AS detection_latency_ms,
 round(avg(se - sc) * 1000, 2) AS publish_latency_ms, round(min(ts_s) FILTER (route = 'anomaly') - min(ts_s) FILTER (label = 1), 3) AS time_to_first_alert,
 round(count(*) FILTER (route = 'anomaly') / ((max(ts_s) - min(ts_s)) / 60), 6) AS alerts_per_minute,
 round((max(ts_s) FILTER (route = 'anomaly') - min(ts_s) FILTER (route = 'anomaly')) / nullif(count(*) FILTER (route = 'anomaly') - 1, 0), 3) AS mean_time_between_alerts,
 round(count(*) FILTER (route = 'anomaly') / count(*)::DOUBLE, 6) AS high_confidence_rate, round(count(*) FILTER (route = 'uncertain') / count(*)::DOUBLE, 6) AS uncertain_rate,
 round(max(ts_s) - min(ts_s) FILTER (route = 'anomaly'), 3) AS lead_time
FROM (SELECT *, ts_s + 1 + u AS sc, ts_s + 2 + 3 * u AS se, {ROUTE} AS route FROM e) GROUP BY user_id"""))
def alert_timing(spark, sf):
    e = events(spark, sf).withColumns({"route": route("score"), "sc": F.col("ts_s") + 1 + F.col("u"),
                                       "se": F.col("ts_s") + 2 + 3 * F.col("u")})
    out = quality.alert_timing(e, ["user_id"], "ts_s", "label", "route", "sc", "se")
    digits = {"detection_latency_ms": 2, "publish_latency_ms": 2, "time_to_first_alert": 3, "mean_time_between_alerts": 3,
              "lead_time": 3, "alerts_per_minute": 6, "high_confidence_rate": 6, "uncertain_rate": 6}
    return out.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query("wn17_alerts_per_shift", with_events(f"""
SELECT ts_us // 28800000000 AS shift, count(*) FILTER (route = 'anomaly') AS alerts, count(*) AS records FROM (SELECT *, {ROUTE} AS route FROM e) GROUP BY 1"""))
def alerts_per_shift(spark, sf):
    return quality.alerts_per_shift(events(spark, sf).withColumn("route", route("score")), "ts_s", "route")


@query("srt01_sorted_summary", with_summary("SELECT dataset, family, model, f1_mean FROM summary ORDER BY dataset, family, model"))
def sorted_summary(spark, sf):
    return summaries(spark, sf).select("dataset", "family", "model", "f1_mean").orderBy("dataset", "family", "model")


@query("srt02_top_three", with_summary("SELECT dataset, model, f1_mean, CAST(place AS INTEGER) AS place FROM t WHERE place <= 3", TOP))
def top_three(spark, sf):
    return top_rows(summaries(spark, sf), ["dataset"], reports.RANKING, 3, "model").select("dataset", "model", "f1_mean", "place")


@query("srt03_preview", "SELECT event_id, value FROM events ORDER BY event_id LIMIT 5")
def preview(spark, sf):
    return table(spark, sf, "events").select("event_id", "value").orderBy("event_id").limit(5)


@query("srt04_message_cap", with_events("SELECT seq, event_id FROM o WHERE seq <= 1000", REPLAY))
def message_cap(spark, sf):
    from ..sources.replay import replay_messages

    sent = replay_messages(events(spark, sf).select("event_id", "label"), "event_id", F.col("label") == 1, {}, EPOCH_MS, 10, 1000)
    return sent.select("seq", "event_id")


@query("srt05_sweep_order", with_events("""
SELECT row_number() OVER (ORDER BY normal_threshold, anomaly_threshold DESC) AS place, policy_name, review_load_ratio FROM pol""", SWEEP, SWEPT))
def sweep_order(spark, sf):
    from pyspark.sql import Window

    swept = threshold_sweep(events(spark, sf), "score", "label")
    # One row per tried pair: at most 36 rows, so one ordering task is enough.
    order = Window.partitionBy(F.lit(0)).orderBy("normal_threshold", F.desc("anomaly_threshold"))
    return rounded(swept.select(F.row_number().over(order).cast("bigint").alias("place"), "policy_name", "review_load_ratio"))


@query("srt06_seeded_shuffle", with_events("SELECT event_id, md5('42:' || event_id) AS sort_key FROM e ORDER BY sort_key, event_id"))
def seeded_shuffle(spark, sf):
    return shuffled(events(spark, sf).select("event_id"), "event_id").withColumn("sort_key", order_key(42, "event_id"))


@query("set01_union_all", with_events("""
SELECT 'normal' AS source, count(*) AS n FROM e WHERE label = 0 UNION ALL SELECT 'anomaly', count(*) FROM e WHERE label = 1"""))
def union_all(spark, sf):
    e = events(spark, sf).select("event_id", "label")
    both = e.where("label = 0").withColumn("source", F.lit("normal")).unionByName(
        e.where("label = 1").withColumn("source", F.lit("anomaly")))
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("set02_ragged_union", with_runs("""
SELECT dataset, model, run, round(f1, 6) AS f1, CAST(NULL AS DOUBLE) AS recall FROM runs UNION ALL
SELECT dataset, model, run, CAST(NULL AS DOUBLE), round(recall, 6) FROM base"""))
def ragged_union(spark, sf):
    keys = ["dataset", "model", "run"]
    return rounded(union_ragged([runs(spark, sf).select("f1", *keys), baseline_runs(spark, sf).select("recall", *keys)], keys))


@query("set03_schema_equality", """
SELECT 'as is' AS against, count(*) AS rows, true AS same FROM events UNION ALL SELECT 'other order', count(*), false FROM events
UNION ALL SELECT 'fewer columns', count(*), false FROM events""")
def schema_equality(spark, sf):
    e = table(spark, sf, "events")
    others = {"as is": e.where("event_type = 'error'"), "other order": e.select(*reversed(e.columns)),
              "fewer columns": e.drop("props")}
    out = [e.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("against"), "rows", F.lit(profile.same_schema(e, other)).alias("same"))
           for name, other in others.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("set04_distinct_labels", "SELECT DISTINCT label FROM embeddings")
def distinct_labels(spark, sf):
    return table(spark, sf, "embeddings").select("label").distinct()
