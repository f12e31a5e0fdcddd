"""Sampling, splitting and rebalancing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.portable import uniform
from ..operators import balance, splits
from .lookups import BLEND, SMOTE
from .registry import query
from .views import events, table, u_sql, vectors, with_events, with_vectors


@query("smp01_bernoulli_downsample", with_events(f"""
SELECT event_id, label FROM e, (SELECT count(*) FILTER (label = 1) / (count(*) FILTER (label = 0))::DOUBLE AS share FROM e)
WHERE label = 1 OR {u_sql('42', 'event_id')} < share"""))
def bernoulli(spark, sf):
    return balance.bernoulli_downsample(events(spark, sf).select("event_id", "label"), "label", "event_id")


@query("smp02_exact_downsample", """
SELECT o_orderkey, o_orderstatus, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42:' || o_orderkey), o_orderkey) AS r
 FROM orders), (SELECT min(n) AS target FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus)) WHERE r <= target""")
def exact(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return balance.exact_downsample(o, "o_orderstatus", "o_orderkey")


@query("smp02_exact_downsample_events", with_events("""
SELECT label, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || event_id), event_id) AS r FROM e),
 (SELECT min(n) AS target FROM (SELECT count(*) AS n FROM e GROUP BY label)) WHERE r <= target GROUP BY label"""))
def exact_events(spark, sf):
    kept = balance.exact_downsample(events(spark, sf).select("event_id", "label"), "label", "event_id")
    return kept.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("smp03_synthetic_minority", with_vectors(f"SELECT slot, base_id, neighbor_id, {BLEND} AS vector FROM syn", *SMOTE))
def synthetic_minority(spark, sf):
    v = vectors(spark, sf)
    grown = balance.synthetic_rows(v, "y", "vec_id", "v", 1, v.where("y = 1").count(), v.count() - 2 * v.where("y = 1").count())
    return grown.select("slot", "base_id", "neighbor_id", F.transform("synthetic_vector", lambda x: F.round(x, 6)).alias("vector"))


@query("smp04_smote_balanced", with_vectors(f"""
SELECT y, synthetic, count(*) AS n, round(sum(total), 4) AS total FROM (SELECT y, false AS synthetic, list_sum(v) AS total FROM v
 UNION ALL SELECT 1, true, list_sum({BLEND}) FROM syn) GROUP BY 1, 2""", *SMOTE))
def smote_balanced(spark, sf):
    grown = balance.smote(vectors(spark, sf).select("vec_id", "y", "v"), "y", "vec_id", "v")
    total = F.aggregate(F.transform("v", lambda x: F.when(F.col("synthetic"), F.round(x, 6)).otherwise(x)), F.lit(0.0), lambda a, x: a + x)
    return grown.groupBy("y", "synthetic").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(total), 4).alias("total"))


@query("smp05_single_minority_jitter", with_vectors("""
SELECT y, synthetic, n FROM (SELECT CAST(vec_id = first AS INTEGER) AS y, false AS synthetic, count(*) AS n FROM v, (SELECT min(vec_id) AS first FROM v) GROUP BY 1
 UNION ALL SELECT 1, true, count(*) - 2 FROM v)"""))
def jitter(spark, sf):
    v = vectors(spark, sf)
    first = v.agg(F.min("vec_id").alias("f")).scalar()
    one = v.select("vec_id", "v", (F.col("vec_id") == first).cast("int").alias("y"))
    return balance.smote(one, "y", "vec_id", "v").groupBy("y", "synthetic").agg(F.count(F.lit(1)).alias("n"))


@query("smp06_hash_split", with_events(f"SELECT event_id, CASE WHEN {u_sql('1234', 'event_id')} < 0.8 THEN 'train' ELSE 'test' END AS split FROM e"))
def hash_split(spark, sf):
    return splits.hash_split(events(spark, sf).select("event_id"), "event_id")


@query("smp07_hash_sample", with_events(f"SELECT event_id, value FROM e WHERE {u_sql('42', 'event_id')} < 0.1"))
def hash_sample(spark, sf):
    return splits.hash_sample(events(spark, sf).select("event_id", "value"), "event_id")


@query("smp08_random_baseline", with_events(f"""
SELECT event_id, CAST({u_sql('10042', 'event_id')} < rate AS INTEGER) AS baseline FROM e, (SELECT avg(label) AS rate FROM e)"""))
def random_baseline(spark, sf):
    e = events(spark, sf).select("event_id", "label")
    rate = e.agg(F.avg(F.col("label").cast("double")).alias("r")).scalar()
    return splits.random_baseline(e.withColumn("rate", rate), "event_id", "rate", 10042).select("event_id", "baseline")


def _family(regime_name: str, side: str) -> str:
    """Class counts of one regime after each preparation."""
    return f"""SELECT '{regime_name}' AS regime, preparation, y, CASE preparation WHEN 'original' THEN n WHEN 'undersample' THEN lo ELSE hi END AS n
 FROM (SELECT y, count(*) AS n FROM v WHERE {u_sql('8', 'vec_id')} {side} 0.5 GROUP BY y),
 (SELECT min(n) AS lo, max(n) AS hi FROM (SELECT count(*) AS n FROM v WHERE {u_sql('8', 'vec_id')} {side} 0.5 GROUP BY y)),
 (SELECT unnest(['original', 'undersample', 'smote']) AS preparation)"""


@query("smp09_dataset_families", with_vectors(_family("standard", "<") + " UNION ALL " + _family("optimized", ">=")))
def families(spark, sf):
    v = vectors(spark, sf).withColumn("regime", F.when(uniform(8, "vec_id") < 0.5, "standard").otherwise("optimized"))
    out = balance.families(v.select("vec_id", "v", "y", "regime"), "regime", "y", "vec_id", "v")
    return out.groupBy("regime", "preparation", "y").agg(F.count(F.lit(1)).alias("n"))


@query("smp_class_shares", with_events(f"""
SELECT label, count(*) AS n FROM e WHERE (label = 0 AND {u_sql('5', 'event_id')} < 0.25) OR (label = 1 AND {u_sql('5', 'event_id')} < 0.75) GROUP BY label"""))
def class_shares(spark, sf):
    return balance.class_sample(events(spark, sf), "label", {0: 0.25, 1: 0.75}, "event_id", 5).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"))
