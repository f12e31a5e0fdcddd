"""Column selection, reshaping and filters."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from ..functions.portable import lenient_int
from ..functions.scalar import grouped, route
from ..operators import metrics, models, profile
from ..operators.routing import Policy, with_route
from ..operators.scaling import standard
from ..sources.readers import feature_columns
from .registry import query
from .views import (
    ROUTE, SENSOR_COLUMNS, events, predictions, rounded, sensors, table, vectors, with_events, with_runs, with_sensors,
    with_vectors,
)


@query("prj01_feature_columns", with_events("SELECT event_id, value, k, hr FROM e"))
def by_exclusion(spark, sf):
    e = events(spark, sf).select("event_id", "ts_s", "label", "value", "k", "hr")
    return e.select(*feature_columns(e, "label", "ts_s"))


@query("prj02_feature_columns_by_position", with_events("SELECT value, k, hr FROM e"))
def by_position(spark, sf):
    e = events(spark, sf).select("ts_s", "label", "value", "k", "hr")
    return e.select(*e.columns[2:])


@query("prj03_columns_by_pattern", with_sensors("""
SELECT count(*) AS n, round(sum("O_w_BLO_power"), 2) AS "O_w_BLO_power", round(sum("O_w_BHL_power"), 2) AS "O_w_BHL_power" FROM s"""))
def by_pattern(spark, sf):
    s = sensors(spark, sf)
    power = profile.columns_containing(s, "power")
    return s.select(*power).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.sum(c), 2).alias(c) for c in power])


@query("prj04_numeric_columns", """
SELECT 'l_orderkey' AS column_name, count(l_orderkey) AS n FROM lineitem UNION ALL
SELECT 'l_partkey', count(l_partkey) FROM lineitem UNION ALL SELECT 'l_suppkey', count(l_suppkey) FROM lineitem UNION ALL
SELECT 'l_linenumber', count(l_linenumber) FROM lineitem UNION ALL SELECT 'l_quantity', count(l_quantity) FROM lineitem UNION ALL
SELECT 'l_extendedprice', count(l_extendedprice) FROM lineitem UNION ALL SELECT 'l_discount', count(l_discount) FROM lineitem UNION ALL
SELECT 'l_tax', count(l_tax) FROM lineitem""")
def by_type(spark, sf):
    t = table(spark, sf, "lineitem")
    names = profile.numeric_columns(t)
    return t.agg(*[F.count(c).alias(c) for c in names]).unpivot([], names, "column_name", "n")


@query("prj05_aligned_union", with_events("""
SELECT label, count(*) AS n, round(sum(value), 4) AS total FROM e GROUP BY label"""))
def aligned_union(spark, sf):
    e = events(spark, sf)
    a, b = e.where("label = 0").select("event_id", "value", "label"), e.where("label = 1").select("label", "value", "event_id")
    return a.union(profile.aligned(b, a)).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("prj06_rename_label", with_events("SELECT event_id, label AS target FROM e"))
def rename_label(spark, sf):
    return events(spark, sf).select("event_id", "label").withColumnRenamed("label", "target")


@query("prj07_cast_label", with_events("""
SELECT event_id, label AS as_int, label::DOUBLE AS as_double, CAST(label AS VARCHAR) AS as_text FROM e"""))
def cast_label(spark, sf):
    c = F.col("label")
    return events(spark, sf).select("event_id", lenient_int("label").alias("as_int"), c.cast("double").alias("as_double"),
                                    c.cast("string").alias("as_text"))


@query("prj08_vector_assembly", with_events("SELECT event_id, [value, k::DOUBLE, hr::DOUBLE] AS features FROM e"))
def vector_assembly(spark, sf):
    e = models.assemble(events(spark, sf).select("event_id", "value", "k", "hr"), ["value", "k", "hr"])
    return e.select("event_id", vector_to_array("features").alias("features"))


@query("prj09_vector_elements", with_vectors("SELECT vec_id, v[1] AS f0, v[2] AS f1, v[64] AS f63 FROM v"))
def vector_elements(spark, sf):
    v = vectors(spark, sf).select("vec_id", array_to_vector("v").alias("vec"))
    names = [f"f{i}" for i in range(64)]
    return models.vector_columns(v, "vec", names).select("vec_id", "f0", "f1", "f63")


@query("prj10_drop_helpers", with_events("SELECT event_id, value FROM e WHERE k >= 50"))
def drop_helpers(spark, sf):
    e = events(spark, sf).select("event_id", "value", "k").withColumn("_flag", F.col("k") >= 50)
    return e.where("_flag").drop("_flag", "k")


@query("prj12_constant_columns", with_events(f"""
SELECT event_id, {ROUTE} AS topic, 'route_uncertain' AS policy FROM e"""))
def constant_columns(spark, sf):
    return with_route(events(spark, sf), name="topic").select("event_id", "topic", F.lit("route_uncertain").alias("policy"))


@query("prj13_channels", with_sensors(" UNION ALL ".join(
    f"SELECT '{sub}' AS subsystem, '{kind}' AS signal_type, '{c}' AS column_name, count(\"{c}\") AS n, "
    f"round(sum(\"{c}\"), 2) AS total FROM s" for c, sub, kind in (
        ("I_w_BLO_Weg", "BLO", "current"), ("O_w_BLO_power", "BLO", "power"), ("O_w_BHL_power", "BHL", "power"),
        ("O_w_BHL_voltage", "BHL", "voltage")))))
def channels(spark, sf):
    long = profile.channels(sensors(spark, sf), SENSOR_COLUMNS)
    return long.groupBy("subsystem", "signal_type", "column_name").agg(
        F.count("reading").alias("n"), F.round(F.sum("reading"), 2).alias("total"))


@query("prj14_feature_groups", with_vectors("""
SELECT vec_id, 16::BIGINT AS n_groups, v[5:8] AS second_group, v[61:64] AS last_group FROM v"""))
def feature_groups(spark, sf):
    g = vectors(spark, sf).select("vec_id", grouped("v", 4).alias("g"))
    return g.select("vec_id", F.size("g").cast("bigint").alias("n_groups"), F.col("g")[1].alias("second_group"),
                    F.col("g")[15].alias("last_group"))


@query("prj15_scatter_projection", "SELECT l_orderkey, l_partkey, l_returnflag FROM lineitem")
def scatter(spark, sf):
    return profile.scatter_projection(table(spark, sf, "lineitem"), "l_returnflag")


@query("flt01_one_class", with_events("SELECT event_id, value FROM e WHERE label = 0"))
def one_class(spark, sf):
    return events(spark, sf).where("label = 0").select("event_id", "value")


@query("flt02_flagged_rows", with_events("SELECT event_id, value FROM e WHERE label = 1"))
def flagged(spark, sf):
    return events(spark, sf).where("label = 1").select("event_id", "value")


@query("flt03_not_outlying", with_events("""
SELECT event_id FROM e, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM e) WHERE abs((value - m) / s) <= 3"""))
def not_outlying(spark, sf):
    e = events(spark, sf).select("event_id", "value")
    z = standard(e.withColumn("z", F.col("value")), ["z"])
    return z.where(~F.coalesce(F.abs("z") > 3, F.lit(False))).select("event_id")


@query("flt04_score_bands", with_events(f"SELECT event_id, {ROUTE} AS route FROM e WHERE {ROUTE} <> 'normal'"))
def score_bands(spark, sf):
    return events(spark, sf).select("event_id", route("score").alias("route")).where("route <> 'normal'")


@query("flt05_confusion_cells", with_runs("""
SELECT dataset, count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label = 0 AND prediction = 0) AS tn,
 count(*) FILTER (label = 0 AND prediction = 1) AS fp, count(*) FILTER (label = 1 AND prediction = 0) AS fn FROM p GROUP BY dataset"""))
def confusion_cells(spark, sf):
    return metrics.confusion(predictions(spark, sf), "label", "prediction", ["dataset"])


@query("flt06_single_class_groups", with_events("""
SELECT user_id, hr, count(*) AS rows FROM e GROUP BY user_id, hr HAVING count(DISTINCT label) < 2"""))
def single_class_groups(spark, sf):
    return metrics.single_class(events(spark, sf), ["user_id", "hr"], "label")


@query("flt07_nonzero_differences", with_runs("""
SELECT r.dataset, r.model, r.run, round(r.f1 - b.f1, 6) AS difference FROM runs r
JOIN base b USING (dataset, model, family, run) WHERE abs(r.f1 - b.f1) > 1e-8"""))
def nonzero_differences(spark, sf):
    from ..operators.ranktest import differences
    from .views import baseline_runs, runs

    keys = ["dataset", "model", "run"]
    both = runs(spark, sf).select(*keys, "f1").join(
        baseline_runs(spark, sf).select(*keys, F.col("f1").alias("b")), keys)
    return rounded(differences(both, "f1", "b", keys))


@query("flt08_dataset_and_valid_label", "SELECT doc_id, quality FROM labels WHERE toxic = 0 AND quality IN (0, 1)")
def dataset_and_valid_label(spark, sf):
    return table(spark, sf, "labels").where((F.col("toxic") == 0) & F.col("quality").isin(0, 1)).select("doc_id", "quality")


@query("flt09_columns_with_missing", with_sensors("""
SELECT 'O_w_BHL_voltage' AS column_name, count(*) FILTER ("O_w_BHL_voltage" IS NULL) AS missing FROM s
HAVING count(*) FILTER ("O_w_BHL_voltage" IS NULL) > 0"""))
def columns_with_missing(spark, sf):
    return profile.null_counts(sensors(spark, sf), only_missing=True)


@query("st08_batch_router", with_events("""
SELECT topic, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM (SELECT event_id, CASE WHEN s > 0.8::DOUBLE THEN 'anomaly'
 WHEN s <= 0.2::DOUBLE THEN 'normal' WHEN s IS NOT NULL THEN 'uncertain' END AS topic
 FROM (SELECT event_id, CASE WHEN hr <> 0 THEN score END AS s FROM e)) WHERE topic IS NOT NULL GROUP BY topic"""))
def batch_router(spark, sf):
    e = events(spark, sf).select("event_id", F.when(F.col("hr") != 0, F.col("score")).alias("score"))
    routed = with_route(e, policy=Policy(), name="topic").where(F.col("topic").isNotNull())
    return routed.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))
