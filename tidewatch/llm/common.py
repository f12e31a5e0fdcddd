"""Helpers of the text operators: byte slices of Arrow batches, vectorised hashes, written tables, hot-key lookups,
connected components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.shared import run_dir

#: Bytes of text that a task hashes at once. It bounds a task's memory; results don't depend on it.
SLICE_BYTES = 1 << 18


# ---------------------------------------------------------------- tables in the shared folder

def written(df: DataFrame, name: str) -> DataFrame:
    """Write once, read many times: cuts lineage, and a lost executor costs no recomputation."""
    path = run_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------- text as bytes

def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def slices(batch: pa.RecordBatch, name: str, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of consecutive rows with about ``limit`` bytes; a longer row is alone."""
    data, offsets = column_bytes(batch.column(name))
    first, rows = 0, len(offsets) - 1
    while first < rows:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, end, data[offsets[first]:offsets[end]], offsets[first:end + 1] - offsets[first]
        first = end


# ---------------------------------------------------------------- hashes

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[LOWER]
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: ASCII bytes other than letters and digits.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        both = []
        for base in (_BASE, _INVERSE):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        return both[0], both[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    p, q = _powers(max(1 << 21, 1 << int(n).bit_length()))
    return p[:n], q[:n]


def prefix_hash(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """P with P[j] - P[i] = base ** i times the polynomial hash of data[i:j]."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * powers(len(data))[0], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], length included."""
    inverse = powers(len(prefix))[1]
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each run of bytes other than white space, or than ``gap``; none crosses a row."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    solid = ~gap[data]
    starts, ends = solid.copy(), solid.copy()
    starts[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    starts[inner] = solid[inner]
    ends[inner - 1] = solid[inner - 1]
    start = np.flatnonzero(starts)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(offsets, start, "right") - 1


def shingles(hashes: np.ndarray, row: np.ndarray, rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes by row, offsets). A row with fewer words has its whole sequence as one; without words none."""
    n = len(hashes)
    count = np.bincount(row, minlength=rows)
    acc = np.zeros(max(0, n - size + 1), np.uint64)
    for k in range(size):
        acc = acc * np.uint64(0x9FB21C651E98DF25) + hashes[k:n - size + 1 + k] if n >= size else acc
    inside = row[:len(acc)] == row[size - 1:size - 1 + len(acc)] if len(acc) else np.zeros(0, bool)
    acc = mix(acc[inside])
    first = np.concatenate([[0], np.cumsum(np.maximum(count - size + 1, 0))])
    word_first = np.concatenate([[0], np.cumsum(count)])
    out, offsets = [], np.zeros(rows + 1, np.int64)
    for r in range(rows):
        if count[r] >= size:
            got = np.sort(acc[first[r]:first[r + 1]])
            if len(got) > 1:
                keep = np.empty(len(got), bool)
                keep[0] = True
                np.not_equal(got[1:], got[:-1], out=keep[1:])
                got = got[keep]
        elif count[r]:
            whole = 0
            for h in hashes[word_first[r]:word_first[r + 1]].tolist():
                whole = (whole * 0x9FB21C651E98DF25 + h) & 0xFFFFFFFFFFFFFFFF
            got = mix(np.array([whole ^ int(count[r])], np.uint64))
        else:
            got = acc[:0]
        out.append(got)
        offsets[r + 1] = offsets[r] + len(got)
    return (np.concatenate(out) if out else acc[:0]), offsets


# ---------------------------------------------------------------- joins and components

def lookup(left: DataFrame, facts: DataFrame, keys: list[str], count: str, hot_share: int = 1000) -> DataFrame:
    """Inner join with one row of ``facts`` for each key, whose ``count`` is the key's rows in ``left``.

    Keys with more than 1/hot_share of all rows are at most hot_share in number; these few are broadcast, so that a hot
    key's rows stay where they are. The rest is joined by shuffle. Null keys match nothing.
    """
    total = facts.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    cut = max(1000, total // hot_share)
    small = facts.filter(F.col(count) <= cut)
    hot = facts.filter(F.col(count) > cut)
    names = hot.select(*keys).withColumn("_hot", F.lit(True))
    tagged = left.join(F.broadcast(names), keys, "left")
    cold_rows = tagged.filter(F.col("_hot").isNull()).drop("_hot").join(small, keys)
    hot_rows = left.join(F.broadcast(hot), keys)
    return cold_rows.unionByName(hot_rows)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component of ``edges`` (u, v); nodes without an edge are absent.

    Alternates large-star and small-star steps until nothing changes, which takes about as many rounds as the logarithm of the
    longest chain. A node's smallest neighbour comes to its edges by ``lookup``, so a hub's edges stay spread. Each step is written
    to the shared folder, so lineage stays short; only counts and checksums reach the driver.
    """
    def checked(df: DataFrame) -> tuple[DataFrame, tuple]:
        out = written(df, "components")
        return out, tuple(out.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def lowest(df: DataFrame) -> DataFrame:
        """Edges with the smallest neighbour of u beside them."""
        return lookup(df, written(df.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "lowest"), ["u"], "n")

    links = edges.select("u", "v").filter("u != v")
    now, mark = checked(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = written(lowest(both).filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).filter("u != v").distinct(), "components")
        small = lowest(large).select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.u", "e.v").filter("u != v").distinct()
        now, seen = checked(small)
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
