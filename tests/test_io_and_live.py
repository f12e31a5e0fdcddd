"""Readers, writers, replay and the streaming job."""

import json

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import joins
from tidewatch.operators.profile import channel_of, same_schema
from tidewatch.operators.routing import Policy
from tidewatch.schema import FEATURES, SUMMARY_COLUMNS, message_schema, sensor_schema
from tidewatch.shared import run_dir, shared_dir
from tidewatch.sources import kafka, readers, writers
from tidewatch.sources.replay import interleave, replay_messages
from tidewatch.streaming import live


def test_schema_sizes():
    assert len(FEATURES) == 18 and FEATURES[:3] == ("I_w_BLO_Weg", "O_w_BLO_power", "O_w_BLO_voltage")
    assert sensor_schema().fieldNames()[:2] == ["Timestamp", "Labels"] and len(SUMMARY_COLUMNS) == 25
    assert message_schema().fieldNames()[:2] == ["message_id", "event_ts_ms"]


def test_bus_options():
    assert kafka.read_options("h:1", "in") == {"kafka.bootstrap.servers": "h:1", "subscribe": "in",
                                               "startingOffsets": "latest", "failOnDataLoss": "true"}
    assert kafka.read_options("h:1", "in", "earliest", 50)["maxOffsetsPerTrigger"] == "50"
    assert kafka.write_options("h:1")["kafka.acks"] == "all"


def test_publish_tolerates_a_missing_bus(spark):
    df = spark.createDataFrame([("t", "k", "v")], "topic string, key string, value string")
    assert kafka.publish(df, "h:1", enabled=False) is False
    assert kafka.publish(df, "h:1") is False


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert run_dir(spark, "x") != run_dir(spark, "x")


def test_loader_needs_a_label(spark):
    path = run_dir(spark, "nolabel")
    spark.range(3).write.option("header", True).csv(path)
    with pytest.raises(ValueError):
        readers.load_labelled(spark, path, order="id")


def test_reports_are_found_in_folders(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "one.json").write_text(json.dumps({"dataset": "d", "model": "m", "f1": 0.5}, indent=1))
    (tmp_path / "a" / "b" / "two.json").write_text(json.dumps([{"dataset": "d", "model": "n"}, {"dataset": "d"}]))
    (tmp_path / "a" / "skip.json").write_text(json.dumps({"dataset": "d", "model": "z"}))
    (tmp_path / "a" / "note.txt").write_text("no json")
    found = readers.read_reports(spark, str(tmp_path), "dataset STRING, model STRING, f1 DOUBLE", skip_file="skip.json")
    assert sorted((r["model"], r["source_file"]) for r in found.collect()) == [("m", "one.json"), ("n", "two.json")]


def test_write_csv_refuses_to_overwrite(spark):
    path = run_dir(spark, "csv")
    writers.write_csv(spark.range(3), path)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        writers.write_csv(spark.range(3), path)


def test_dataset_layout_order(spark):
    df = spark.createDataFrame([(5, 1, 2.0, 1.0), (3, 0, 4.0, 3.0)], "id int, Labels int, b double, a double")
    out = writers.dataset_layout(df, ["a", "b"], order="id")
    assert out.columns == ["Timestamp", "Labels", "a", "b"]
    assert sorted(map(tuple, out.collect())) == [(0.0, 0, 3.0, 4.0), (1.0, 1, 1.0, 2.0)]


def test_same_schema(spark):
    a = spark.createDataFrame([(1, 2)], "a int, b int")
    assert same_schema(a, a.select("*")) and not same_schema(a, a.select("b", "a"))


@pytest.mark.parametrize("name, want", [("I_w_BLO_Weg", ("BLO", "current")), ("O_w_HR_power", ("HR", "power")),
                                        ("O_w_HL_voltage", ("HL", "voltage"))])
def test_channel_names(spark, name, want):
    sub, kind = channel_of(F.lit(name))
    assert tuple(spark.range(1).select(sub, kind).first()) == want


@pytest.mark.parametrize("normals, anomalies, order", [(7, 3, "nnannannan"), (2, 4, "nanaaa"), (0, 3, "aaa"), (3, 0, "nnn"), (4, 4, "nananana")])
def test_interleave(spark, normals, anomalies, order):
    df = spark.createDataFrame([(i, 0) for i in range(normals)] + [(100 + i, 1) for i in range(anomalies)], "id int, y int")
    rows = interleave(df, "id", F.col("y") == 1).orderBy("seq").collect()
    assert [r["seq"] for r in rows] == list(range(1, len(rows) + 1))
    assert "".join("na"[r["y"]] for r in rows) == order
    assert [r["id"] for r in rows if r["y"] == 0] == list(range(normals))


def test_replay_pace_and_cap(spark):
    df = spark.createDataFrame([(i, i % 2, 1.5) for i in range(10)], "id int, y int, x double")
    sent = replay_messages(df, "id", F.col("y") == 1, {"x": F.col("x")}, 1000, 10, max_messages=4).orderBy("seq").collect()
    assert [r["event_ts_ms"] for r in sent] == [1000, 1010, 1020, 1030]
    assert json.loads(sent[0]["payload"]) == {"message_id": "msg-00000001", "event_ts_ms": 1000, "x": 1.5}


def test_duplicate_scores_collapse_to_the_last(spark):
    records = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("z", 4)], "message_id string, off int")
    scores = spark.createDataFrame([("a", 0.1, 1), ("a", 0.7, 2), ("b", 0.3, 1)], "message_id string, score double, seq int")
    got = sorted((r["off"], r["score"]) for r in joins.attach_scores(records, scores, "message_id", "seq").collect())
    assert got == [(1, 0.7), (2, 0.7), (3, 0.3)]


SCHEMA = "message_id STRING, event_ts_ms BIGINT, label INT, x DOUBLE, score DOUBLE"


def envelope(rows):
    return [("in", i % 2, i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(rows)]


def msg(i, score, **extra):
    return {"message_id": f"m{i}", "event_ts_ms": 1000 + i, "label": i % 2, "x": 1.0, "score": score, **extra}


ROWS = [msg(0, 0.9), msg(1, 0.1), msg(2, 0.5), msg(3, None), {**msg(4, 0.9), "message_id": None}, {**msg(5, 0.9), "x": None}, "{broken"]


def test_live_job_routes_logs_and_quarantines(spark):
    source, out = run_dir(spark, "source"), run_dir(spark, "out")
    ddl = "topic string, partition int, offset bigint, value string"
    feed = lambda rows: spark.createDataFrame(envelope(rows), ddl).coalesce(1).write.mode("append").parquet(source)
    writer = live.batch_writer(out, F.col("score"), ["x"], processed_ms=F.lit(1500).cast("bigint"),
                               lag=spark.createDataFrame([("in", 0, 7)], "topic string, partition int, consumer_lag bigint"))

    def run():
        stream = spark.readStream.schema(ddl).parquet(source)
        live.start(live.decode(stream, SCHEMA), writer, f"{out}/progress", interval=None).awaitTermination()

    feed(ROWS)
    run()
    routed = {r["message_id"]: r for r in spark.read.json(f"{out}/routed").collect()}
    assert {k: r["route"] for k, r in routed.items()} == {"m0": "anomaly", "m1": "normal", "m2": "uncertain", "m3": "normal"}
    assert routed["m0"]["e2e_latency_ms"] == 500 and routed["m0"]["consumer_lag"] == 7 and routed["m1"]["consumer_lag"] == 0
    reasons = [r["reject_reason"] for r in spark.read.json(f"{out}/quarantine").collect()]
    assert sorted(reasons) == ["missing_feature", "no_id", "no_id"]
    line = spark.read.json(f"{out}/metrics").first()
    assert (line["records_processed"], line["anomaly_count"], line["normal_count"], line["uncertain_count"]) == (4, 1, 2, 1)
    assert line["lag_by_partition"] == "(in-0,7),(in-1,0)" and line["total_consumer_lag"] == 7

    run()
    assert spark.read.json(f"{out}/metrics").count() == 1
    feed([msg(10, 0.95)])
    run()
    assert spark.read.json(f"{out}/metrics").count() == 2 and spark.read.json(f"{out}/routed").count() == 5


def test_a_batch_that_runs_again_changes_nothing(spark):
    out = run_dir(spark, "again")
    batch = live.decode(spark.createDataFrame(envelope(ROWS), "topic string, partition int, offset bigint, value string"), SCHEMA)
    write = live.batch_writer(out, F.col("score"), ["x"], Policy(topics=("a", "n", "u")))
    write(batch, 3)
    write(batch, 3)
    assert spark.read.json(f"{out}/routed").count() == 4 and spark.read.json(f"{out}/metrics").count() == 1
    write(batch.limit(0), 4)
    assert spark.read.json(f"{out}/metrics").count() == 1


def test_a_fitted_model_scores_the_stream(spark):
    from tidewatch.operators import models

    train = spark.createDataFrame([(float(i), int(i > 50)) for i in range(100)], "x double, label int")
    fitted = models.fit("logistic_regression", train, ["x"], "label")
    rows = [msg(0, None, x=99.0), msg(1, None, x=1.0)]
    batch = live.decode(spark.createDataFrame(envelope(rows), "topic string, partition int, offset bigint, value string"), SCHEMA)
    out = run_dir(spark, "scored")
    live.batch_writer(out, lambda df: models.with_scores(fitted, df.drop("score")), ["x"])(batch, 0)
    assert {r["message_id"]: r["route"] for r in spark.read.json(f"{out}/routed").collect()} == {"m0": "anomaly", "m1": "normal"}


def test_messages_carry_every_field(spark):
    batch = live.decode(spark.createDataFrame(envelope([msg(0, 0.9)]), "topic string, partition int, offset bigint, value string"), SCHEMA)
    out = live.as_messages(live.routed(batch, F.col("score"), processed_ms=F.lit(2000))).first()
    body = json.loads(out["value"])
    assert out["topic"] == "anomaly" and out["key"] == "m0" and list(body) == list(live.ROUTED)


@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
def test_hot_keys_are_salted_without_changing_the_join(spark, monkeypatch, how):
    monkeypatch.setattr(joins, "MIN_HOT", 5)
    rows = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"k{i % 50}" if i % 7 else None) for i in range(600)], "id int, k string")
    side = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("unused", 4)], "k string, x int")
    seen = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert seen(joins.spread_join(rows, side, "k", how)) == seen(rows.join(side, "k", how))


def test_copies_of_a_hot_key_get_several_salts(spark):
    rows = spark.createDataFrame([("hot",)] * 400 + [("cold",)] * 5, "k string")
    hot = spark.createDataFrame([("hot", 14)], "k string, _salts int")
    salts = {k: {r["_salt"] for r in joins.salted(rows, hot, "k").where(F.col("k") == k).collect()} for k in ("hot", "cold")}
    assert len(salts["hot"]) == 14 and salts["cold"] == {0}


def test_salts_do_not_depend_on_the_order_of_the_input(spark):
    """A task that runs again over reordered rows deals them out alike: nothing is lost or doubled between salts."""
    rows = [("hot", i % 5 if i % 2 else 0) for i in range(600)] + [("hot", None), ("cold", 1)]
    hot = spark.createDataFrame([("hot", 7)], "k string, _salts int")
    seen = [sorted(map(str, joins.salted(spark.createDataFrame(r, "k string, x int").repartition(n), hot, "k").collect()))
            for r, n in ((rows, 1), (rows[::-1], 3), (sorted(rows, key=str), 5))]
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == len(rows)
    equal = joins.salted(spark.createDataFrame(rows, "k string, x int"), hot, "k").where("k = 'hot' and x = 0").groupBy("_salt").count().collect()
    assert len(equal) == 7 and max(r["count"] for r in equal) <= 60


def test_text_numbers_and_broken_messages(spark):
    texts = ['{"message_id":"a","event_ts_ms":"17","label":"1.0","x":2.0}', "not json", '{"message_id":"b","label":null}']
    rows = live.decode(spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "value string, offset bigint"),
                       "message_id STRING, event_ts_ms BIGINT, label INT, x DOUBLE, value DOUBLE").orderBy("offset").collect()
    assert (rows[0]["event_ts_ms"], rows[0]["label"]) == (17, 1) and [r["raw_value"] for r in rows] == texts
    assert rows[1]["label"] is None and rows[2]["label"] is None and rows[0]["value"] is None


def test_a_sink_and_a_lag_by_batch(spark):
    batch = live.decode(spark.createDataFrame(envelope(ROWS), "topic string, partition int, offset bigint, value string"), SCHEMA)
    got = {}
    lag = lambda n: spark.createDataFrame([("in", p, 5 + n) for p in range(3)], "topic string, partition int, consumer_lag bigint")
    out = run_dir(spark, "sink")
    write = live.batch_writer(out, F.col("score"), ["x"], lag=lag, sink=lambda rows, n: got.update({n: rows.collect()}))
    write(batch, 0)
    write(batch, 1)
    assert {r["key"] for r in got[0]} == {r["key"] for r in got[1]} and len(got[0]) == 4
    first, second = ({json.loads(r["value"])["consumer_lag"] for r in got[n]} for n in (0, 1))
    assert first in ({5}, {0}) and (first == {0} or second == {6})


@pytest.mark.parametrize("name", ["st01_micro_batch_loop", "st04_live_batch_metrics", "st03_live_saved_model", "st_event_time_windows_streamed"])
def test_arrivals_are_written_by_many_tasks(spark, sf, tmp_path, monkeypatch, name):
    from __spark_entry__ import queries
    from tidewatch.plans import live as plans

    wide = str(tmp_path)
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(f"{wide}/events.parquet")
    paths = {}

    def noted(session, kind):
        paths[kind] = run_dir(session, kind)
        return paths[kind]

    monkeypatch.setattr(plans, "run_dir", noted)
    want, got = (sorted(map(str, queries()[name](spark, d).collect())) for d in (sf, wide))
    assert got == want
    path = paths.get("arriving") or paths["ending"]
    assert spark.read.parquet(path).select(F.input_file_name()).distinct().count() >= (12 if "arriving" in paths else 4)
