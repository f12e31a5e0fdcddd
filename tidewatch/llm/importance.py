"""Importance resampling towards a target distribution, with segments counted once.

Texts are bags of hashed word runs (1 to ``size`` words). What the corpus holds of each bucket is counted by segments: newlines
cut texts into lines, equal lines meet in one shuffle, each distinct line's runs are counted once and multiplied by its
occurrences, and runs that cross lines are counted separately, text by text. A bucket's gain is the logarithm of its share in
the target over its share in the corpus; a text's weight is the sum of its runs' gains, and Gumbel noise of its id on top turns
the highest scores into a draw without replacement.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.ordered import range_cuts, ranked, with_range_bucket

from .common import PUNCTUATION, slices, words, written

#: Buckets at most; counts of all are brought to the driver, and gains are sent to every task.
MAX_BUCKETS = 1 << 20
#: Bytes of a word that are hashed for all words at once; the rest of longer words is hashed one word after another.
_TOGETHER = 64
_FULL = np.uint32(0xFFFFFFFF)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()


def _step(register: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return _CRC[(register ^ byte) & 255] ^ (register >> 8)


def crc_onward(register: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 registers after data[start:end] has followed."""
    length = end - start
    order = np.argsort(-length, kind="stable")
    at, short, out = start[order], -length[order], register[order]
    for k in range(min(_TOGETHER, int(-short[0]) if len(short) else 0)):
        live = int(np.searchsorted(short, -k, "left"))
        out[:live] = _step(out[:live], data[at[:live] + k])
    for i in range(int(np.searchsorted(short, -_TOGETHER, "left"))):
        rest = data[at[i] + _TOGETHER:at[i] - short[i]]
        out[i] = zlib.crc32(rest, int(out[i] ^ _FULL)) ^ 0xFFFFFFFF
    back = np.empty_like(out)
    back[order] = out
    return back


def word_runs(data: np.ndarray, start: np.ndarray, end: np.ndarray, part: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For 1 to ``size`` words: (CRC-32 of the words joined by a space, first word) of each run within one part."""
    data = _LOWER[data]
    first = np.arange(len(start))
    register = np.full(len(start), _FULL)
    for n in range(size):
        if n:
            inside = np.flatnonzero(part[first[first + n < len(start)]] == part[first[first + n < len(start)] + n])
            first, register = first[inside], _step(register[inside], np.uint8(32))
        register = crc_onward(register, data, start[first + n], end[first + n])
        yield register ^ _FULL, first


Counter = Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray | None]]]


def _tallied(df: DataFrame, buckets: int, found: Counter) -> DataFrame:
    """(bucket, n): what ``found`` yields as (hashes, times or None for once each), summed in each task and then by bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for hashes, times in found(batch):
                np.add.at(total, hashes % np.uint32(buckets), 1 if times is None else times)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], ["bucket", "n"])

    return df.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _texts(df: DataFrame) -> DataFrame:
    return df.select(F.col("text").cast("string").alias("text"))


def segment_counts(df: DataFrame, size: int = 1, buckets: int = 10_000) -> DataFrame:
    """(bucket, n) of all word runs of all texts, from distinct lines times their occurrences and runs across lines."""
    lines = _texts(df).select(F.explode(F.split("text", "\n", -1)).alias("line")).filter("line != ''").groupBy("line").agg(F.count("*").alias("n"))

    def within(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        times = batch.column("n").to_numpy()
        for first, _, data, offsets in slices(batch, "line"):
            start, end, row = words(data, offsets, PUNCTUATION)
            for hashes, at in word_runs(data, start, end, row, size):
                yield hashes, times[first + row[at]]

    def across(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, None]]:
        for _, _, data, offsets in slices(batch, "text"):
            start, end, row = words(data, offsets, PUNCTUATION)
            line = np.cumsum(data == 10)[start] if len(start) else start
            for n, (hashes, at) in enumerate(word_runs(data, start, end, row, size)):
                yield hashes[line[at] != line[at + n]], None

    inner = _tallied(lines, buckets, within)
    return inner if size == 1 else inner.unionByName(_tallied(_texts(df), buckets, across)).groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = 10_000) -> DataFrame:
    """(bucket, gain): floor(1000 * ln of the bucket's add-one share of target runs over that of corpus runs)."""
    if not 0 < buckets <= MAX_BUCKETS:
        raise ValueError(f"buckets must be 1 to {MAX_BUCKETS}")
    both = (corpus.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
            .join(corpus.select("bucket", F.col("n").alias("s")), "bucket", "left").join(target.select("bucket", F.col("n").alias("t")), "bucket", "left")
            .select("bucket", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in "st")))
    all_s, all_t = (both.agg(F.sum(c).alias("n")).scalar() for c in "st")
    ratio = (F.col("t") + 1) * (all_s + buckets) / ((F.col("s") + 1) * (all_t + buckets))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


WEIGHED = "doc_id long, n_words long, n_features long, weight long"


def weigh(docs: DataFrame, gains: np.ndarray, size: int = 1) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row's whole text; ``gains`` by bucket."""
    sent = docs.sparkSession.sparkContext.broadcast(gains.astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in slices(batch, "text"):
                start, end, row = words(data, offsets, PUNCTUATION)
                out = np.zeros((3, last - first), np.int64)
                out[0] = np.bincount(row, minlength=last - first)
                for hashes, at in word_runs(data, start, end, row, size):
                    count = np.bincount(row[at], minlength=last - first)
                    stop = np.cumsum(count)
                    upto = np.concatenate([[0], np.cumsum(sent.value[hashes % np.uint32(len(gains))])])
                    out[1] += count
                    out[2] += upto[stop] - upto[stop - count]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), *map(pa.array, out)],
                                                 ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, WEIGHED)


def draw(weighed: DataFrame, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """Adds score and rank (1, 2, 3, ... of the drawn, else null): weight with Gumbel noise of ``seed:doc_id``, highest first.

    The cut through the ranks is found by counts of range buckets; only rows of the buckets above it are ranked.
    """
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    scored = weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0))))
    open_ = scored.filter(F.col("n_words") >= least_words).withColumn("_below", -F.col("score"))
    bucketed = with_range_bucket(open_, "_below", cuts=range_cuts(open_, ["_below"])["_below"])
    counts = sorted((r[0], r[1]) for r in bucketed.groupBy("_bucket").count().collect())
    wanted = percent * sum(n for _, n in counts) // 100
    upto, seen = -1, 0
    for bucket, n in counts:
        if seen >= wanted:
            break
        upto, seen = bucket, seen + n
    placed = ranked(bucketed.filter(F.col("_bucket") <= upto), [], ["_below", F.asc_nulls_last("doc_id"), "n_features"])
    kept = ["doc_id", "n_words", "n_features", "weight", "score"]
    drawn = placed.select(*kept, F.when(F.col("rank") <= wanted, F.col("rank")).cast("long").alias("rank"))
    rest = (bucketed.filter(F.col("_bucket") > upto).select(*kept).unionByName(scored.filter(F.col("n_words") < least_words).select(*kept))
            .withColumn("rank", F.lit(None).cast("long")))
    return drawn.unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, size: int = 1, buckets: int = 10_000, **settings) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_features, weight, score, rank.

    A null or empty text has no runs and weight 0, and is never drawn unless least_words is 0. Equal scores go to the smaller
    doc_id, null ids last (their noise is that of the empty id); repeated rows are rows like others, next to each other in rank. An
    empty target or corpus leaves the add-one shares. Columns other than doc_id and text are not read. ``settings`` as in `draw`.
    """
    gains = written(bucket_gains(segment_counts(docs, size, buckets), segment_counts(target, size, buckets), buckets), "gains")
    table = np.zeros(buckets, np.int64)
    for bucket, gain in gains.collect():
        table[bucket] = gain
    return draw(written(weigh(docs, table, size), "weighed"), **settings)
