import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from plain import ODD, lower
from pyspark.sql import functions as F

from tidewatch.llm.common import PUNCTUATION, column_bytes, words
from tidewatch.llm.importance import bucket_gains, crc_onward, draw, resample, segment_counts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text, size):
    w = WORD.findall(lower(text))
    return [" ".join(w[i:i + n]) for n in range(1, size + 1) for i in range(len(w) - n + 1)]


def bucket(run, buckets):
    return zlib.crc32(run.encode()) % buckets


def plain(rows, target, size, buckets, percent, least, seed):
    s, t = (Counter(bucket(r, buckets) for x in texts for r in runs(x, size)) for texts in ([x for _, x in rows], target))
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in range(buckets)]
    out = []
    for i, x in rows:
        f = runs(x, size)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(r, buckets)] for r in f)
        out.append([i, len(runs(x, 1)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    allowed = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    top = len(allowed) * percent // 100
    ranked = [(*r, k + 1 if k < top else None) for k, r in enumerate(allowed)]
    return Counter(ranked + [(*r, None) for r in out if r[1] < least])


def test_crc_of_words_of_all_lengths():
    text = " ".join("é🙂xyz"[k % 5] * k for k in range(1, 200)) + " " + "q" * 100_000
    data, offsets = column_bytes(pa.array([text]))
    start, end, _ = words(data, offsets, PUNCTUATION)
    got = crc_onward(np.full(len(start), 0xFFFFFFFF, np.uint32), data, start, end) ^ np.uint32(0xFFFFFFFF)
    assert got.tolist() == [zlib.crc32(w.encode()) for w in text.split(" ")]


@pytest.mark.parametrize("size,buckets", [(1, 10_000), (2, 97), (3, 10_000)])
def test_segment_counts_equal_counts_of_whole_texts(spark, odd, size, buckets):
    got = {r["bucket"]: r["n"] for r in segment_counts(odd, size, buckets).collect()}
    assert got == Counter(bucket(r, buckets) for x in ODD for r in runs(x[1], size))


@pytest.mark.parametrize("size,buckets,percent,least", [(1, 10_000, 10, 20), (2, 501, 40, 2), (3, 64, 100, 0)])
def test_resample_odd_rows(spark, odd, size, buckets, percent, least):
    target = spark.createDataFrame([("one two three\nfour five W1 w2",), (None,), ("",)], "text string")
    got = Counter(tuple(r) for r in resample(odd, target, size, buckets, percent=percent, least_words=least).select(
        "doc_id", "n_words", "n_features", "weight", "score", "rank").collect())
    assert got == plain([(r[0], r[1]) for r in ODD], ["one two three\nfour five W1 w2", None, ""], size, buckets, percent, least, 2024)


def test_resample_bigrams_of_a_table(spark, sf, documents):
    target = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = Counter(tuple(r) for r in resample(documents, target, 2, 1000, percent=25).collect())
    rows, texts = [(r["doc_id"], r["text"]) for r in documents.collect()], [r["text"] for r in target.collect()]
    assert got == plain(rows, texts, 2, 1000, 25, 20, 2024)


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    assert resample(none, odd).count() == 0
    rows = resample(odd, none.select("text")).collect()
    assert len(rows) == len(ODD)
    with pytest.raises(ValueError):
        bucket_gains(segment_counts(odd), segment_counts(odd), 0)


def test_draw_breaks_ties_by_id_over_many_buckets(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(30).cast("long").alias("n_words"), F.lit(30).cast("long").alias("n_features"),
                                    F.lit(0).cast("long").alias("weight"))
    got = {r["doc_id"]: (r["score"], r["rank"]) for r in draw(rows.repartition(7), percent=33).collect()}
    order = sorted(got, key=lambda i: (-got[i][0], i))
    assert [got[i][1] for i in order] == [k + 1 if k < 1650 else None for k in range(5000)]
    assert len({s for s, _ in got.values()}) < 5000
