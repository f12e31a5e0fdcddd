"""A message log kept as a table, streamed with an offset for each partition like a bus.

The log is a folder ``partition=<p>/*.parquet`` of messages with rising offsets, written by ordinary Spark jobs. The stream reader
plans offset ranges from file footers, and its tasks read only the files and row groups of their range. It starts at the earliest
or latest message or at given offsets, takes a limit per trigger, and goes on from a query's progress after a restart. Paths are
read by Arrow: local folders, hdfs and the object stores it knows.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

# Readers travel to the workers by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NAME = "table_log"
#: Rows of a batch, and of a row group of the log.
BATCH, ROW_GROUP_BYTES = 1 << 13, 8 << 20
#: Rows of a log of one task when it is written, about.
RANGE = 1 << 18
SCHEMA = "key string, value string, topic string, partition int, offset bigint"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Segment:
    """One file: its partition and the offsets it holds, first and end."""
    path: str
    partition: int
    first: int
    end: int


def segments(path: str, known: dict[str, Segment] | None = None) -> list[Segment]:
    """All files of a log with their offsets, from footers; ``known`` keeps those read before."""
    store, root = _place(path)
    known = {} if known is None else known
    out = []
    for info in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        if info.type != fs.FileType.File or not info.path.endswith(".parquet") or "/_temporary/" in info.path:
            continue
        if info.path not in known:
            with store.open_input_file(info.path) as f:
                meta = pq.ParquetFile(f).metadata
            at = meta.schema.names.index("offset")
            stats = [meta.row_group(i).column(at).statistics for i in range(meta.num_row_groups) if meta.row_group(i).num_rows]
            if not stats:
                continue
            part = next(p for p in info.path.split("/") if p.startswith("partition="))
            known[info.path] = Segment(info.path, int(part.split("=")[1]), min(s.min for s in stats), max(s.max for s in stats) + 1)
        out.append(known[info.path])
    return out


def end_offsets(path: str) -> dict[int, int]:
    """The offset after the last message of each partition."""
    out: dict[int, int] = {}
    for s in segments(path):
        out[s.partition] = max(out.get(s.partition, 0), s.end)
    return out


@dataclass
class Range(InputPartition):
    partition: int
    first: int
    end: int
    files: list[str]

    def __post_init__(self) -> None:
        super().__init__(None)


class LogReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.topic = options["path"], options.get("topic", "input")
        self.starting = options.get("startingOffsets", "latest")
        self.limit = int(options.get("maxOffsetsPerTrigger", 0))
        self.progress = options.get("progress")
        if self.limit and not self.progress:
            raise ValueError("maxOffsetsPerTrigger needs progress, the query's checkpoint folder")
        self.known: dict[str, Segment] = {}
        self.at: dict[str, int] | None = None

    def _ends(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for s in segments(self.path, self.known):
            out[str(s.partition)] = max(out.get(str(s.partition), 0), s.end)
        return out

    def initialOffset(self) -> dict:
        ends = self._ends()
        if self.starting == "latest":
            return ends
        given = {} if self.starting == "earliest" else {str(k): int(v) for k, v in json.loads(self.starting).items()}
        least: dict[str, int] = {}
        for s in self.known.values():
            least[str(s.partition)] = min(least.get(str(s.partition), s.first), s.first)
        return {p: given.get(p, least[p]) for p in ends} | {p: o for p, o in given.items() if p not in ends}

    def _reached(self) -> dict[str, int]:
        """Where the query stands: what was planned last, else its progress folder, else the start."""
        if self.at is None and self.progress:
            store, root = _place(self.progress)
            batches = [i.path for i in store.get_file_info(fs.FileSelector(f"{root}/offsets", allow_not_found=True)) if i.base_name.isdigit()]
            if batches:
                with store.open_input_file(max(batches, key=lambda b: int(b.rsplit("/", 1)[1]))) as f:
                    self.at = json.loads(f.read().decode().splitlines()[2])
        return self.initialOffset() if self.at is None else self.at

    def latestOffset(self) -> dict:
        ends = self._ends()
        if self.limit:
            share, reached = -(-self.limit // max(1, len(ends))), self._reached()
            ends = {p: max(reached.get(p, 0), min(e, reached.get(p, 0) + share)) for p, e in ends.items()}
            self.at = ends
        return ends

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        files = segments(self.path, self.known)
        out = []
        for p, e in end.items():
            first = start.get(p, 0)
            # A file is a range of its own; files whose offsets overlap are read together.
            end_of = first
            for s in sorted((s for s in files if s.partition == int(p) and s.first < e and s.end > first), key=lambda s: (s.first, s.end)):
                if out and out[-1].partition == int(p) and s.first < end_of:
                    out[-1].files.append(s.path)
                    out[-1].end = end_of = max(end_of, min(e, s.end))
                else:
                    end_of = min(e, s.end)
                    out.append(Range(int(p), max(first, s.first), end_of, [s.path]))
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, _ = _place(self.path)
        offset = ds.field("offset")
        # Nothing is read ahead: a task holds one batch and the row group it comes from.
        rows = ds.dataset(partition.files, filesystem=store, format="parquet").to_batches(
            columns=["key", "value", "offset"], filter=(offset >= partition.first) & (offset < partition.end),
            batch_size=BATCH, batch_readahead=0, fragment_readahead=0, use_threads=False,
            fragment_scan_options=ds.ParquetFragmentScanOptions(use_buffered_stream=True, pre_buffer=False))
        for batch in rows:
            n = batch.num_rows
            if n:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").cast(pa.string()), batch.column("value").cast(pa.string()), pa.array([self.topic] * n),
                     pa.array([partition.partition] * n, pa.int32()), batch.column("offset").cast(pa.int64())], ["key", "value", "topic", "partition", "offset"])


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LogReader:
        return LogReader(self.options)


def append(messages: DataFrame, path: str) -> None:
    """Add ``partition, offset, key, value`` rows to a log; offsets must lie behind those it holds."""
    rows = messages.select("partition", F.col("offset").cast("bigint").alias("offset"), F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))
    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "partition", F.expr(f"offset div {RANGE}"))
    dealt.sortWithinPartitions("partition", "offset").write.mode("append").option("parquet.block.size", ROW_GROUP_BYTES).option(
        "maxRecordsPerFile", RANGE).partitionBy("partition").parquet(path)


def subscribe(spark: SparkSession, path: str, topic: str = "input", starting: str = "latest", max_per_trigger: int | None = None,
              progress: str | None = None) -> DataFrame:
    """The same columns as the bus: ``key, value, topic, partition, offset``. ``starting`` is ``earliest``, ``latest`` or offsets as JSON."""
    spark.dataSource.register(LogSource)
    reader = spark.readStream.format(NAME).option("path", path).option("topic", topic).option("startingOffsets", starting)
    if max_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", str(max_per_trigger)).option("progress", progress)
    return reader.load()
