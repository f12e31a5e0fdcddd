"""The table log as a source, lag from a query's progress, and reconciliation on tables."""

import json

import pytest
from pyspark.sql import functions as F

from tidewatch.shared import run_dir
from tidewatch.sources import tablelog
from tidewatch.streaming import reconcile


@pytest.fixture()
def log(spark):
    path = run_dir(spark, "log")
    rows = spark.range(40).select((F.col("id") % 3).cast("int").alias("partition"), F.expr("id div 3 + 5").alias("offset"), F.col("id").cast("string").alias("key"),
                                  F.lit("{}").alias("value"))
    tablelog.append(rows.where("offset < 12"), path)
    tablelog.append(rows.where("offset >= 12"), path)
    return path


def reader(path, **options):
    return tablelog.LogReader({"path": path, **options})


def test_offsets_from_footers(log):
    assert tablelog.end_offsets(log) == {0: 19, 1: 18, 2: 18}
    assert reader(log).initialOffset() == {"0": 19, "1": 18, "2": 18}
    assert reader(log, startingOffsets="earliest").initialOffset() == {"0": 5, "1": 5, "2": 5}
    assert reader(log, startingOffsets='{"1": 9, "7": 3}').initialOffset() == {"0": 5, "1": 9, "2": 5, "7": 3}
    assert reader(log + "-absent", startingOffsets="earliest").latestOffset() == {}


def test_ranges_read_each_message_once(log):
    r = reader(log, startingOffsets="earliest")
    cut = {"0": 11, "1": 5, "2": 14}
    seen = []
    for a, b in ((r.initialOffset(), cut), (cut, r.latestOffset()), (r.latestOffset(), r.latestOffset())):
        for part in r.partitions(a, b):
            for batch in r.read(part):
                seen += batch.to_pylist()
    assert sorted(int(m["key"]) for m in seen) == list(range(40))
    assert {m["topic"] for m in seen} == {"input"} and all(m["offset"] == int(m["key"]) // 3 + 5 for m in seen)


def test_limit_goes_on_from_progress(log, tmp_path):
    with pytest.raises(ValueError):
        reader(log, maxOffsetsPerTrigger="6")
    options = {"startingOffsets": "earliest", "maxOffsetsPerTrigger": "6", "progress": str(tmp_path)}
    r = reader(log, **options)
    assert r.latestOffset() == {"0": 7, "1": 7, "2": 7} and r.latestOffset() == {"0": 9, "1": 9, "2": 9}
    (tmp_path / "offsets").mkdir()
    for batch, at in ((9, 8), (10, 17)):
        (tmp_path / "offsets" / str(batch)).write_text("v1\n{}\n" + json.dumps({"0": at, "1": at, "2": at}))
    assert reader(log, **options).latestOffset() == {"0": 19, "1": 18, "2": 18}


def test_lag_of_a_batch(spark, tmp_path):
    (tmp_path / "offsets").mkdir()
    (tmp_path / "offsets" / "3").write_text('v1\n{}\n{"a":{"0":10,"1":4}}\n{"0":7}')
    lag = reconcile.progress_lag(spark, str(tmp_path), lambda: {"a": {0: 15, 1: 2}, "input": {0: 8}})(3)
    assert {(r["topic"], r["partition"]): r["consumer_lag"] for r in lag.collect()} == {("a", 0): 5, ("a", 1): 0, ("input", 0): 1}
    assert reconcile.by_topic("not json", "t") == {} == reconcile.by_topic(None, "t") and reconcile.by_topic("17", "t") == {}


def test_reconciliation_on_tables(spark):
    sent = spark.createDataFrame([("a", 0), ("b", 0), ("c", 0), (None, 0)], "id string, s int").select("id", F.timestamp_seconds("s").alias("at"), F.lit("t").alias("expected"))
    got = spark.createDataFrame([("a", 60), ("b", 7200), (None, 5)], "id string, s int").select("id", F.timestamp_seconds("s").alias("at"), F.lit("t").alias("actual"))
    rows = {r["key"]: r["lost"] for r in reconcile.reconciled(sent, got, "id", "at", "at").collect()}
    assert rows == {"a": False, "b": True, "c": True, None: True}


def test_a_large_log_is_written_and_read_in_ranges(spark, tmp_path, monkeypatch):
    """More than one file a partition, each a range of its own; each message of any offsets is read once, by small batches."""
    monkeypatch.setattr(tablelog, "RANGE", 1000)
    monkeypatch.setattr(tablelog, "BATCH", 300)
    rows = spark.range(20_000).selectExpr("CAST(id % 2 AS INT) AS partition", "id div 2 AS offset", "CAST(id AS STRING) AS key", "CAST(id AS STRING) AS value")
    path = str(tmp_path / "log")
    tablelog.append(rows.where("offset < 5500"), path)
    tablelog.append(rows.where("offset >= 5500"), path)
    reader = tablelog.LogReader({"path": path})
    ranges = reader.partitions({"0": 10, "1": 2500}, {"0": 10_000, "1": 7777})
    batches = [b for r in ranges for b in reader.read(r)]
    keys = sorted(int(k) for b in batches for k in b.column("key").to_pylist())
    assert keys == sorted([2 * o for o in range(10, 10_000)] + [2 * o + 1 for o in range(2500, 7777)])
    assert len(ranges) >= 6 and max(b.num_rows for b in batches) <= 300


def test_order_and_copies_across_batches(spark, tmp_path, monkeypatch):
    """Flags of four micro-batches equal those of one pass over the messages: missing ids and times, copies in one batch and far apart; state of
    ids lies in parts, of which lots are put together."""
    import random

    monkeypatch.setattr(reconcile, "LOTS", 2)
    monkeypatch.setattr(reconcile, "BUCKETS", 3)
    rnd, log, out = random.Random(5), str(tmp_path / "log"), str(tmp_path / "out")
    store = "spark.sql.streaming.stateStore.providerClass"
    rows = [(p, o, rnd.choice([None, f"once-{o}", *[f"m{i}" for i in range(9)]]), rnd.choice([None, 10**15 + 10 * o, 10**15 + 10 * o - 25])) for p in range(2) for o in range(60)]
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k in range(4):
            part = spark.createDataFrame([r for r in rows if r[1] // 15 == k], "partition int, offset bigint, key string, value bigint")
            tablelog.append(part.withColumn("value", F.col("value").cast("string")), log)
            flags = reconcile.ordered_flags(tablelog.subscribe(spark, log, starting="earliest"), "key", "value")
            flags.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(store)
    want, latest, seen = set(), {}, {}
    for p, o, i, t in rows:
        n = seen.get((p, i), 0) if i else 0
        seen[p, i] = n + 1
        want.add((p, o, t is not None and t < latest.get(p, 0), n > 0, n == 1))
        latest[p] = max(latest.get(p, 0), t or 0)
    got = [tuple(r) for r in spark.read.schema(reconcile.FLAGS).parquet(f"{out}/rows").select("partition", "offset", "late", "copy", "second").collect()]
    assert len(got) == len(rows) and set(got) == want
    assert sum(r[3] for r in want) > 40 and sum(r[2] for r in want) > 10
