"""Joins: score and lag lookups, neighbours, grids, baselines, reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.portable import uniform
from ..operators import joins, reports
from ..operators.balance import synthetic_rows
from ..operators.neighbors import knn_classify, nearest
from ..operators.profile import class_roles
from ..operators.routing import Policy, policy_quality
from ..operators.thresholds import CLASSIFIER_GRID, threshold_measures
from .registry import query
from .views import (
    ROUTE, baseline_runs, events, rounded, runs, summaries, table, u_sql, vectors, with_events, with_runs, with_summary,
    with_vectors,
)


@query("jn01_records_with_last_score", with_events("""
SELECT e.event_id, e.k, round(l.last_score, 6) AS last_score FROM e JOIN (SELECT k, arg_max(score, event_id) AS last_score FROM e
 WHERE label = 1 GROUP BY k) l USING (k)"""))
def last_score(spark, sf):
    e = events(spark, sf)
    scores = e.where("label = 1").select("k", F.col("score").alias("last_score"), "event_id")
    return rounded(joins.attach_scores(e.select("event_id", "k"), scores, "k", "event_id"))


LAG = """o AS (SELECT event_type AS topic, hr AS "partition", max(event_id) AS end_offset,
 max(CASE WHEN label = 0 THEN event_id ELSE event_id - 7 END) - (hr % 3) AS until_offset FROM e GROUP BY event_type, hr)"""


def _offsets(spark, sf):
    read = F.max(F.when(F.col("label") == 0, F.col("event_id")).otherwise(F.col("event_id") - 7))
    return events(spark, sf).groupBy(F.col("event_type").alias("topic"), F.col("hr").alias("partition")).agg(
        F.max("event_id").alias("end_offset"), (read - F.pmod(F.col("hr"), F.lit(3))).alias("until_offset"))


@query("jn02_records_with_lag", with_events("""
SELECT e.event_id, coalesce(CASE WHEN e.hr <> 0 THEN greatest(0, end_offset - until_offset) END, 0) AS consumer_lag
FROM e LEFT JOIN o ON e.event_type = o.topic AND e.hr = o."partition" """, LAG))
def records_with_lag(spark, sf):
    lag = joins.consumer_lag(_offsets(spark, sf)).where("partition <> 0")
    e = events(spark, sf).select("event_id", F.col("event_type").alias("topic"), F.col("hr").alias("partition"))
    return joins.attach_lag(e, lag).select("event_id", "consumer_lag")


@query("st06_consumer_lag", with_events("""
SELECT topic, "partition", greatest(0, end_offset - until_offset) AS consumer_lag FROM o""", LAG))
def consumer_lag(spark, sf):
    return joins.consumer_lag(_offsets(spark, sf))


KNN = """d AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, list_distance(a.v, b.v) AS distance, b.y AS ny, b.label AS nl
 FROM v a JOIN v b ON {on}),
nn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM d)"""


@query("jn03_nearest_vote", with_vectors("""
SELECT query_id, arg_min(nl, struct_pack(a := -n, b := nl)) AS prediction FROM (SELECT query_id, nl, count(*) AS n FROM nn
 WHERE rank <= 5 GROUP BY query_id, nl) GROUP BY query_id""", KNN.format(on="a.vec_id <> b.vec_id")))
def nearest_vote(spark, sf):
    """Leave-one-out vote: every row against all others."""
    v = vectors(spark, sf)
    return knn_classify(v, v, 5, "vec_id", "vec_id", "v", "label", exclude_self=True)


@query("jn04_minority_neighbours", with_vectors("""
SELECT query_id, neighbor_id, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM nn WHERE rank <= 5""",
       KNN.format(on="a.y = 1 AND b.y = 1 AND a.vec_id <> b.vec_id")))
def minority_neighbours(spark, sf):
    m = vectors(spark, sf).where("y = 1")
    return rounded(nearest(m, m, 5, "vec_id", "vec_id", "v", exclude_self=True))


SLOTS = f"""c AS (SELECT count(*) FILTER (y = 0) AS maj, count(*) FILTER (y = 1) AS mn FROM v),
m AS (SELECT vec_id, v, row_number() OVER (ORDER BY vec_id) AS pos FROM v WHERE y = 1),
slots AS (SELECT slot, CAST(floor({u_sql('42-base', 'slot')} * mn) AS BIGINT) + 1 AS pos,
 CAST(floor({u_sql('42-near', 'slot')} * 5) AS BIGINT) + 1 AS rank, {u_sql('42-gap', 'slot')} AS gap
 FROM (SELECT unnest(range(maj - mn)) AS slot, mn FROM c)),
syn AS (SELECT slot, m.vec_id AS base_id, nn.neighbor_id, gap, m.v AS a, w.v AS b FROM slots JOIN m USING (pos)
 JOIN nn ON nn.query_id = m.vec_id AND nn.rank = slots.rank JOIN v w ON w.vec_id = nn.neighbor_id)"""
SMOTE = (KNN.format(on="a.y = 1 AND b.y = 1 AND a.vec_id <> b.vec_id"), SLOTS)
BLEND = "list_transform(list_zip(a, b), lambda z: round(z[1] + (z[2] - z[1]) * gap, 6) + 0.0::DOUBLE)"


@query("jn05_slots_to_pairs", with_vectors("SELECT slot, base_id, neighbor_id, round(gap, 6) AS gap FROM syn", *SMOTE))
def slots_to_pairs(spark, sf):
    v = vectors(spark, sf)
    roles = class_roles(v, "y").first()
    rows = synthetic_rows(v, "y", "vec_id", "v", roles["minority"], roles["minority_rows"], roles["to_generate"])
    return rounded(rows.select("slot", "base_id", "neighbor_id", "gap"))


@query("jn06_scores_by_threshold_grid", with_events("""
SELECT t AS threshold, count(*) FILTER (score >= t AND label = 1) AS tp, count(*) FILTER (score < t AND label = 0) AS tn,
 count(*) FILTER (score >= t AND label = 0) AS fp, count(*) FILTER (score < t AND label = 1) AS fn
FROM e, (SELECT unnest([%s]) AS t) GROUP BY t""" % ", ".join(f"{t!r}::DOUBLE" for t in CLASSIFIER_GRID)))
def threshold_grid(spark, sf):
    return threshold_measures(events(spark, sf), "score", "label", CLASSIFIER_GRID).select("threshold", "tp", "tn", "fp", "fn")


@query("jn08_runs_with_baseline", with_runs("""
SELECT dataset, model, run, round(r.f1, 6) AS f1, round(b.f1, 6) AS baseline_f1, round(r.f1 - b.f1, 6) AS lift
FROM runs r JOIN base b USING (dataset, model, run)"""))
def runs_with_baseline(spark, sf):
    keys = ["dataset", "model", "run"]
    out = joins.with_baseline(runs(spark, sf), baseline_runs(spark, sf), keys)
    return rounded(out.select(*keys, "f1", "baseline_f1", "lift"))


@query("jn09_paired_deltas", with_runs("""
SELECT a.dataset, a.model, round(b.f1 - a.f1, 6) AS f1_delta, round(b.precision - a.precision, 6) AS precision_delta,
 round(b.recall - a.recall, 6) AS recall_delta FROM
 (SELECT dataset, model, avg(f1) AS f1, avg(precision) AS precision, avg(recall) AS recall FROM base GROUP BY 1, 2) a JOIN
 (SELECT dataset, model, avg(f1) AS f1, avg(precision) AS precision, avg(recall) AS recall FROM runs GROUP BY 1, 2) b
 USING (dataset, model)"""))
def paired_deltas(spark, sf):
    keys, measures = ["dataset", "model"], ["f1", "precision", "recall"]
    mean = lambda df: df.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in measures])
    out = joins.paired_deltas(mean(baseline_runs(spark, sf)), mean(runs(spark, sf)), keys, measures)
    return rounded(out.select(*keys, *[f"{m}_delta" for m in measures]))


KPIS = ("tp", "fn", "fp", "predicted_positive", "prevented_manual_checks", "review_reduction", "review_compression",
        "false_positive_rate", "miss_rate", "baseline_lift", "alerts_per_1000", "caught_per_1000", "false_alarms_per_1000")
COUNTS = """counts AS (SELECT 'd' || CAST(hr // 6 AS VARCHAR) AS dataset, count(*) AS total_rows,
 count(*) FILTER (label = 0) AS normal_rows, count(*) FILTER (label = 1) AS anomaly_rows FROM e GROUP BY 1)"""


def dataset_counts(spark, sf):
    e = events(spark, sf)
    return e.groupBy(F.concat(F.lit("d"), F.floor(F.col("hr") / 6).cast("string")).alias("dataset")).agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(F.col("label") == 0).alias("normal_rows"),
        F.count_if(F.col("label") == 1).alias("anomaly_rows"))


@query("jn10_best_model_with_counts", with_summary("""
SELECT dataset, arg_min(model, struct_pack(a := -f1_mean, b := -recall_mean, c := -precision_mean, d := model)) AS model,
 max(f1_mean) AS f1_mean, any_value(total_rows) AS total_rows, any_value(anomaly_rows) AS anomaly_rows
FROM summary JOIN counts USING (dataset) GROUP BY dataset""", COUNTS))
def best_with_counts(spark, sf):
    best = reports.best_per_dataset(summaries(spark, sf))
    return joins.lookup(best, dataset_counts(spark, sf), ["dataset"], "inner").select(
        "dataset", "model", "f1_mean", "total_rows", "anomaly_rows")


@query("jn11_lookup_with_fallback", """
SELECT c_nationkey, display_name, count(*) AS n FROM (SELECT c_nationkey, coalesce(CASE WHEN n_regionkey <> 0 THEN n_name END,
 CAST(c_nationkey AS VARCHAR)) AS display_name FROM orders JOIN customer ON o_custkey = c_custkey
 LEFT JOIN nation ON c_nationkey = n_nationkey) GROUP BY 1, 2""")
def lookup_with_fallback(spark, sf):
    o = table(spark, sf, "orders").join(
        table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    names = table(spark, sf, "nation").where("n_regionkey <> 0").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("display_name"))
    return joins.lookup_name(o, names, "c_nationkey", "display_name").groupBy("c_nationkey", "display_name").agg(
        F.count(F.lit(1)).alias("n"))


@query("jn12_deltas_to_baseline_row", with_summary("""
SELECT dataset, model, round(f1_mean - bf, 6) AS delta_f1_mean, round(recall_mean - br, 6) AS delta_recall_mean
FROM summary, (SELECT max(f1_mean) AS bf, max(recall_mean) AS br FROM summary WHERE dataset = 'd0' AND model = 'u1')"""))
def deltas_to_row(spark, sf):
    s = summaries(spark, sf)
    ref = (F.col("dataset") == "d0") & (F.col("model") == "u1")
    out = joins.deltas_to_row(s, ref, ["f1_mean", "recall_mean"])
    return rounded(out.select("dataset", "model", "delta_f1_mean", "delta_recall_mean"))


@query("jn14_delivery_reconciliation", with_events(f"""
SELECT user_id, count(*) AS input_messages, count(*) FILTER (NOT got) AS lost_messages,
 count(*) FILTER (route = 'anomaly') AS expected_alerts, count(*) FILTER (route = 'anomaly' AND got AND actual = route) AS delivered_alerts,
 round(count(*) FILTER (NOT got) / count(*)::DOUBLE, 6) AS message_loss_rate,
 round(coalesce(count(*) FILTER (route = 'anomaly' AND got AND actual = route) / nullif(count(*) FILTER (route = 'anomaly'), 0)::DOUBLE, 0), 6)
 AS alert_delivery_success
FROM (SELECT user_id, {ROUTE} AS route, CASE WHEN k < 5 THEN 'uncertain' ELSE {ROUTE} END AS actual,
 {u_sql('9', 'event_id')} >= 0.02 AS got FROM e) GROUP BY user_id"""))
def delivery(spark, sf):
    from ..functions.scalar import route

    e = events(spark, sf).withColumn("route", route("score"))
    delivered = e.where(uniform(9, "event_id") >= 0.02).select(
        "event_id", F.when(F.col("k") < 5, "uncertain").otherwise(F.col("route")).alias("actual"))
    return rounded(joins.delivery(e, delivered, "event_id", "route", "actual", "anomaly", ["user_id"]))


@query("jn14_lost_messages", with_events(f"SELECT event_id FROM e WHERE {u_sql('9', 'event_id')} < 0.02"))
def lost(spark, sf):
    e = events(spark, sf).select("event_id")
    return joins.lost_messages(e, e.where(uniform(9, "event_id") >= 0.02), "event_id")


@query("st_policy_with_and_without_review", with_events("""
SELECT p AS policy_name, count(*) FILTER (score > 0.8::DOUBLE) AS anomaly_topic_count,
 CASE WHEN p = 'review' THEN count(*) FILTER (score > 0.2::DOUBLE AND score <= 0.8::DOUBLE) ELSE 0 END AS review_topic_count
FROM e, (SELECT unnest(['drop', 'review']) AS p) GROUP BY p"""))
def with_and_without_review(spark, sf):
    out = policy_quality(events(spark, sf), "score", "label",
                         {"drop": Policy(review_uncertain=False), "review": Policy()})
    return out.select("policy_name", "anomaly_topic_count", "review_topic_count")
