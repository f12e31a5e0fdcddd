"""Live checks that span micro-batches: lag from a query's own progress, lost messages, order and copies by source partition."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

# The processor travels to the workers by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LAG = "topic string, partition int, consumer_lag bigint"


class OffsetListener(StreamingQueryListener):
    """Keeps the newest available offsets that the running queries report, for sources that can't be asked directly."""

    def __init__(self) -> None:
        self.latest: dict[str, dict[int, int]] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for source in event.progress.sources:
            for text in (source.latestOffset, source.endOffset):
                for topic, ends in by_topic(text, "input").items():
                    held = self.latest.setdefault(topic, {})
                    for p, o in ends.items():
                        held[p] = max(held.get(p, 0), o)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def by_topic(text: str | None, topic: str) -> dict[str, dict[int, int]]:
    """Offsets of a source as {topic: {partition: offset}}; a source of one topic leaves its name out. Anything else gives nothing."""
    try:
        read = json.loads(text) if text else {}
    except ValueError:
        return {}
    if not isinstance(read, dict):
        return {}
    if read and all(isinstance(v, int) for v in read.values()):
        read = {topic: read}
    return {t: {int(p): int(o) for p, o in ends.items()} for t, ends in read.items() if isinstance(ends, dict)}


def progress_lag(spark: SparkSession, checkpoint: str, ends: Callable[[], dict[str, dict[int, int]]], topic: str = "input") -> Callable[[int], DataFrame]:
    """Lag table of a batch: what ``ends`` says is there, less what the query's own offset log says the batch reads up to.

    Spark writes that log before it runs a batch, so a batch that runs again
    after a failure is rated by the same offsets. For ``live.batch_writer(lag=)``.
    """
    def lag(batch_id: int) -> DataFrame:
        lines = [r[0] for r in spark.read.text(f"{checkpoint}/offsets/{batch_id}").collect()]
        until: dict[tuple[str, int], int] = {}
        for line in lines[2:]:
            until |= {(t, p): o for t, read in by_topic(line, topic).items() for p, o in read.items()}
        there = ends()
        rows = [(t, p, max(0, there.get(t, {}).get(p, o) - o)) for (t, p), o in until.items()]
        return spark.createDataFrame(rows, LAG)

    return lag


def reconciled(sent: DataFrame, delivered: DataFrame, key: str, sent_at: str, delivered_at: str, within: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Every sent message once, with the time and topic of its delivery or, when the watermarks have passed ``within``, without.

    A stream-stream left join with watermarks on both sides, so state is
    bounded by ``within`` and ``delay``. ``sent`` has key, sent_at, expected;
    ``delivered`` has key, delivered_at, actual. Batch tables give the same rows.
    """
    a = sent.select(F.col(key).alias("key"), F.col(sent_at).alias("sent_at"), "expected").withWatermark("sent_at", delay)
    b = delivered.select(F.col(key).alias("_key"), F.col(delivered_at).alias("delivered_at"), "actual").withWatermark("delivered_at", delay)
    on = (F.col("key") == F.col("_key")) & (F.col("delivered_at") >= F.col("sent_at")) & (F.col("delivered_at") <= F.col("sent_at") + F.expr(f"INTERVAL {within}"))
    return a.join(b, on, "leftOuter").select("key", "sent_at", "expected", "delivered_at", "actual", F.col("_key").isNull().alias("lost"))


FLAGS = "partition int, offset bigint, late boolean, copy boolean, second boolean"


#: Ids of a source partition are kept in so many parts; a batch calls on the state of each part it meets, which takes a while.
BUCKETS = 16
#: Lots of ids of one part before they are put together.
LOTS = 16
#: Stands for a missing time; no time lies below it.
_NEVER = -(1 << 63)


def _packed(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _unpacked(lots) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(bytes(lot)).read_all() for lot in lots])


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(partition, the messages of one batch): state operators are handed rows one by one, so a row holds many messages."""
    for batch in batches:
        of = batch.column("partition").dictionary_encode("encode")
        for i, p in enumerate(of.dictionary.to_pylist()):
            mine = pa.Table.from_batches([batch.filter(pc.equal(of.indices, i))])
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([_packed(mine)], pa.binary())], ["partition", "lot"])


def _flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lot in batch.column("lot").to_pylist():
            yield from _unpacked([lot]).to_batches()


class _Late(StatefulProcessor):
    """Per source partition: the latest time seen. Hands on the messages by parts of their ids."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "ts bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        whole = _unpacked(lot for f in rows for lot in f["lot"])
        whole = whole.take(pa.array(np.argsort(whole["offset"].to_numpy(), kind="stable")))
        ts = whole["ts"].to_numpy()
        before = np.maximum.accumulate(np.concatenate([[self.latest.get()[0] if self.latest.exists() else _NEVER], ts]))
        if before[-1] != _NEVER:
            self.latest.update((int(before[-1]),))
        whole = whole.drop_columns(["ts"]).append_column("late", pa.array((ts != _NEVER) & (ts < before[:-1])))
        part = whole["part"].to_numpy()
        order = np.argsort(part, kind="stable")
        parts, first = np.unique(part[order], return_index=True)
        for p, at in zip(parts.tolist(), np.split(order, first[1:])):
            yield pd.DataFrame({"partition": pd.array(whole["partition"][:1].to_pylist(), "Int32"), "part": [p], "lot": [_packed(whole.take(pa.array(at)))]})

    def close(self) -> None:
        pass


class _Copies(StatefulProcessor):
    """Per part of a source partition's ids: how often each came, ids expiring after a while.

    A batch adds one packed lot of the ids that it holds and their counts so far; the last lot that names an id counts.
    """

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getListState("seen", "lot binary", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # One lot a batch, in the order of its offsets.
        whole = _unpacked(lot for f in rows for lot in f["lot"])
        ids = whole["id"].to_pandas()
        known = ids.notna().to_numpy()
        place, names = pd.factorize(ids[known])
        lots = [r[0] for r in self.seen.get()] if self.seen.exists() else []
        counts = [_unpacked(lots).to_pandas()] if lots else []
        held = pd.concat([*counts, pd.DataFrame({"id": pd.Series(dtype=object), "n": pd.Series(dtype="int64")})]).drop_duplicates("id", keep="last")
        before = pd.Series(held["n"].to_numpy(), index=pd.Index(held["id"].to_numpy(), dtype=object)).reindex(names).fillna(0).to_numpy(np.int64)
        n = np.full(len(whole), -1)
        n[known] = before[place] + ids[known].groupby(place).cumcount().to_numpy()
        if len(names):
            new = pd.DataFrame({"id": names, "n": before + np.bincount(place, minlength=len(names))})
            # Expiry is by lot, so lots of ids that expire stay apart.
            if len(lots) >= LOTS and not self.ttl_ms:
                self.seen.put([(_packed(_counts(pd.concat([held, new]).drop_duplicates("id", keep="last"))),)])
            else:
                self.seen.appendValue((_packed(_counts(new)),))
        flags = pa.table({"partition": whole["partition"], "offset": whole["offset"], "late": whole["late"], "copy": n > 0, "second": n == 1})
        yield pd.DataFrame({"lot": [_packed(flags)]})

    def close(self) -> None:
        pass


def _counts(counts: pd.DataFrame) -> pa.Table:
    return pa.table({"id": pa.array(counts["id"], pa.string()), "n": pa.array(counts["n"], pa.int64())})


def ordered_flags(stream: DataFrame, message_id: str = "message_id", ts: str = "event_ts_ms", ttl_ms: int | None = None) -> DataFrame:
    """Per message: out of order within its source partition, a copy of an id seen there before, and the first such copy.

    State is kept across micro-batches (the session needs a state store that takes it, as RocksDB's): the latest time by source
    partition, and the ids by parts of it, so that these are spread over all tasks. A batch's messages of one partition are sorted by
    offset in memory; the source's limit per trigger bounds them. Null ids are no copies; ``ttl_ms`` lets ids expire.
    """
    part = F.pmod(F.xxhash64(F.coalesce(F.col(message_id), F.col("offset").cast("string"))), F.lit(BUCKETS)).cast("int")
    rows = stream.select("partition", "offset", F.col(message_id).alias("id"), F.coalesce(F.col(ts).cast("bigint"), F.lit(_NEVER).cast("bigint")).alias("ts"), part.alias("part"))
    lots = rows.mapInArrow(_lots, "partition int, lot binary")
    timed = lots.groupBy("partition").transformWithStateInPandas(_Late(), "partition int, part int, lot binary", "Append", "None")
    flagged = timed.groupBy("partition", "part").transformWithStateInPandas(_Copies(ttl_ms), "lot binary", "Append", "ProcessingTime" if ttl_ms else "None")
    return flagged.mapInArrow(_flags, FLAGS)
