"""Exact removal of repeated byte strings, by column-wise construction over aligned passages.

Every ``length``-byte window owns the smallest of its ``GRAM``-byte hashes (its anchor), so equal windows own equal anchors at
equal offsets. Anchors are counted by Spark; those found once end there. What surrounds an anchor (its passage: every
window that can own it) is compared as a whole first: passages found twice are repeated throughout. The other passages of
an anchor are aligned on it and ordered column by column from the right: each round inserts one symbol of every passage,
turns the order of the previous column's suffixes into the order of this column's (one stable pass over the symbols that
precede them, that is the collection's Burrows-Wheeler transform), and carries the common prefixes of neighbours along.
Columns lie in one sequential external file that the rounds read backwards. A window is repeated if its suffix shares
``length`` bytes with a neighbour. Passages of anchors with very many different surroundings are counted window by window
in Spark instead, so that no task holds an unbounded group.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lookup, mix, prefix_hash, range_hash, slices, written

GRAM = 32
#: Never a byte of UTF-8.
PAD = 255
#: Passages of one anchor above which its windows are counted in Spark, and passages ordered by one task.
GROUP_PASSAGES, TASK_PASSAGES = 20_000, 5_000


# ---------------------------------------------------------------- anchors

def _sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of values[j:j + width] for every j; by prefixes and suffixes of blocks."""
    op, rest = (np.minimum, np.iinfo(values.dtype).max) if least else (np.maximum, 0)
    n = len(values)
    blocks = np.full(-(-n // width) * width + width, rest, values.dtype)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    ahead = op.accumulate(blocks, axis=1).ravel()
    back = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[:n], ahead[width - 1:width - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, row, gram hash, passage hash) of every anchor of the slice."""
    width = length - GRAM + 1
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none
    prefix = prefix_hash(data)
    start = np.arange(len(data) - GRAM + 1)
    grams = range_hash(prefix, start, start + GRAM)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    end = offsets[row + 1]
    rank = (grams >> np.uint64(32)).astype(np.uint32)
    rank[start + GRAM > end[:len(start)]] = np.iinfo(np.uint32).max
    lowest = _sliding(rank, width, True)
    lowest[start + length > end[:len(start)]] = 0
    # Position i is an anchor if some window that starts in [i - width + 1, i] has its rank as minimum.
    padded = np.concatenate([np.zeros(width - 1, np.uint32), lowest])
    at = np.flatnonzero((_sliding(padded, width, False)[:len(start)] == rank) & (rank < np.iinfo(np.uint32).max))
    row = row[at]
    low, high = np.maximum(offsets[row], at - (length - GRAM)), np.minimum(offsets[row + 1], at + length)
    passage = mix(range_hash(prefix, low, high) + (at - low).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    return at, row, grams[at].view(np.int64), passage.view(np.int64)


def _text_keys(ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit key of (id, text): rows with the same id and different texts stay apart."""
    text = range_hash(prefix_hash(data), offsets[:-1], offsets[1:])
    number = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return mix(mix(number + ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint64) * np.uint64(0x51ED270B9F5C1234)) + text).view(np.int64)


def _anchored(length: int):
    schema = pa.schema([("uid", pa.int64()), ("p", pa.int64()), ("a", pa.int64()), ("c", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for first, last, data, offsets in slices(batch, "text"):
                uid = _text_keys(ids.slice(first, last - first), data, offsets)
                at, row, gram, passage = anchors(data, offsets, length)
                yield pa.RecordBatch.from_arrays([pa.array(uid[row]), pa.array(at - offsets[row]), pa.array(gram), pa.array(passage)], schema=schema)

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("packed", pa.binary())])
    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        ids = batch.column("doc_id")
        for first, last, data, offsets in slices(batch, "text"):
            own = ids.slice(first, last - first)
            packed = [packer.compress(data[offsets[i]:offsets[i + 1]].tobytes()) for i in range(last - first)]
            yield pa.RecordBatch.from_arrays([pa.array(_text_keys(own, data, offsets)), own, pa.array(packed, pa.binary())], schema=schema)


# ---------------------------------------------------------------- passages

def _cut_passages(length: int):
    """One row (a, many, uid, p, passage padded to 2 * length - GRAM bytes) for each place of a document."""
    reach = length - GRAM
    schema = pa.schema([("a", pa.int64()), ("many", pa.bool_()), ("uid", pa.int64()), ("p", pa.int64()), ("passage", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for uid, packed, places in zip(batch.column("uid").to_pylist(), batch.column("packed"), batch.column("places"), strict=True):
                text = unpack.decompress(packed.as_py())
                out: list[tuple] = []
                for place in places.as_py():
                    p = place["p"]
                    low, high = max(0, p - reach), min(len(text), p + length)
                    out.append((place["a"], place["many"], uid, p,
                                b"\xff" * (reach - (p - low)) + text[low:high] + b"\xff" * (length - (high - p))))
                    if len(out) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def repeated_windows(passages: list[bytes], length: int) -> np.ndarray:
    """Boolean matrix, passage x start: whether the window of ``length`` bytes from there equals one of another passage
    at the same start. All passages are aligned and as long as 2 * length - GRAM."""
    m, columns = len(passages), 2 * length - GRAM
    starts = columns - length + 1
    out = np.zeros((m, starts), bool)
    with tempfile.TemporaryFile() as file:
        np.ascontiguousarray(np.frombuffer(b"".join(passages), np.uint8).reshape(m, columns).T).tofile(file)
        order, common = np.arange(m), np.zeros(m + 1, np.int32)
        for column in range(columns - 1, -1, -1):
            file.seek(column * m)
            symbol = np.fromfile(file, np.uint8, m)[order]  # the transform: what precedes the suffixes in their order
            to = np.argsort(symbol, kind="stable")
            symbol, order = symbol[to], order[to]
            same = (symbol[1:] == symbol[:-1]) & (symbol[1:] != PAD)
            bounds = np.empty(2 * (m - 1), np.int64)
            bounds[::2], bounds[1::2] = to[:-1] + 1, to[1:] + 1
            grown = np.zeros(m + 1, np.int32)
            if m > 1:
                grown[1:m][same] = (np.minimum.reduceat(common, bounds)[::2] + 1)[same]
            common = grown
            if column < starts:
                hit = common[1:m] >= length
                out[order[1:][hit], column] = True
                out[order[:-1][hit], column] = True
    return out


def _runs(hit: np.ndarray, shift: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte, end byte) of the runs of repeated starts of each row."""
    edge = np.diff(np.pad(hit.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    _, last = np.nonzero(edge == -1)
    return row, first + shift[row], last - 1 + shift[row] + length


def _ordered(length: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        hit = repeated_windows(list(group["passage"]), length)
        row, s, e = _runs(hit, group["p"].to_numpy() - (length - GRAM), length)
        return pd.DataFrame({"uid": group["uid"].to_numpy()[row], "s": s, "e": e})

    return run


def _windows(length: int):
    """(x, y, uid, s): two hashes of each window that lies inside the document."""
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("uid", pa.int64()), ("s", pa.int64())])
    starts = length - GRAM + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, p, passage in zip(batch.column("uid").to_pylist(), batch.column("p").to_pylist(), batch.column("passage").to_pylist(), strict=True):
                data = np.frombuffer(passage, np.uint8)
                at = np.arange(starts)
                pads = np.concatenate([[0], np.cumsum(data == PAD)])
                at = at[pads[at + length] == pads[at]]
                x = range_hash(prefix_hash(data), at, at + length)
                y = range_hash(prefix_hash(data ^ np.uint8(0x5A)), at, at + length)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64)), pa.array(np.full(len(at), uid)),
                                                  pa.array(at + p - (length - GRAM))], schema=schema)

    return run


def _finished(with_text: bool):
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
              ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))]
    schema = pa.schema(fields + ([("uid", pa.int64()), ("kept_text", pa.string())] if with_text else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out: dict[str, list] = {name: [] for name in schema.names}
            waiting = 0
            for doc, uid, packed, spans in zip(batch.column("doc_id").to_pylist(), batch.column("uid").to_pylist(), batch.column("packed"),
                                               batch.column("spans"), strict=True):
                text = unpack.decompress(packed.as_py())
                merged: list[list[int]] = []
                for span in sorted((x["s"], min(x["e"], len(text))) for x in spans.as_py() or []):
                    s, e = max(0, span[0]), span[1]
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                edges = [0, *(x for span in merged for x in span), len(text)]
                kept = b"".join(text[edges[i]:edges[i + 1]] for i in range(0, len(edges), 2))
                values = (doc, len(text), len(text) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(),
                          [{"s": s, "e": e} for s, e in merged], uid, kept.decode("utf-8", "ignore") if with_text else None)
                for name, value in zip(schema.names, values, strict=False):
                    out[name].append(value)
                waiting += len(text)
                if waiting > 4 << 20:
                    yield pa.RecordBatch.from_pydict(out, schema=schema)
                    out, waiting = {name: [] for name in schema.names}, 0
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return run


def remove_repeats(docs: DataFrame, length: int = 200, group_passages: int = GROUP_PASSAGES, task_passages: int = TASK_PASSAGES,
                   with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) for each row: bytes covered by a ``length``-byte string
    that also starts elsewhere, in the same text or another.

    Texts are UTF-8 bytes, null is empty; shorter texts than ``length`` lose nothing; repeated rows count as copies; a null
    id is a row of its own. Strings are judged on the input. ``with_text`` adds uid (key of id and text) and kept_text, in which
    bytes of a character cut in half are left out. Columns other than doc_id and text are not read.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} at least")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    every = written(source.mapInArrow(_anchored(length), "uid long, p long, a long, c long"), "anchors")
    twice = written(every.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1"), "anchor-counts")
    found = written(lookup(every, twice, ["a"], "n").select("uid", "p", "a", "c"), "anchors-again")
    passages = written(found.groupBy("a", "c").agg(F.count("*").alias("n"), F.min(F.struct("uid", "p")).alias("first")), "passages")
    whole = lookup(found, passages.filter("n > 1").select("a", "c", "n"), ["a", "c"], "n").select(
        "uid", F.greatest(F.col("p") - (length - GRAM), F.lit(0)).alias("s"), (F.col("p") + length).alias("e"))
    several = passages.groupBy("a").agg(F.count("*").alias("m")).filter("m > 1")
    open_ = lookup(passages.select("a", "first"), several, ["a"], "m")

    texts = source.mapInArrow(_packed, "uid long, doc_id long, packed binary")
    places = open_.select("a", (F.col("m") > group_passages).alias("many"), "first.uid", "first.p").groupBy("uid").agg(
        F.collect_list(F.struct("p", "a", "many")).alias("places"))
    cut = written(places.join(texts, "uid").select("uid", "packed", "places").mapInArrow(
        _cut_passages(length), "a long, many boolean, uid long, p long, passage binary"), "aligned")
    tasks = max(1, -(-cut.filter("not many").count() // task_passages))
    ordered = cut.filter("not many").withColumn("task", F.pmod(F.xxhash64("a"), F.lit(tasks))).groupBy("task").applyInPandas(
        _ordered(length), "uid long, s long, e long")
    windows = cut.filter("many").mapInArrow(_windows(length), "x long, y long, uid long, s long").distinct()
    counted = windows.groupBy("x", "y").agg(F.count("*").alias("n")).filter("n > 1")
    single = lookup(windows, counted, ["x", "y"], "n").select("uid", "s", (F.col("s") + length).alias("e"))

    spans = whole.unionByName(ordered).unionByName(single).distinct().groupBy("uid").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<s:long,e:long>>"
    return texts.join(spans, "uid", "left").mapInArrow(_finished(with_text), schema + (", uid long, kept_text string" if with_text else ""))


def cut_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """``docs`` with repeated strings cut out of ``text`` (and n_chars, if there is one, counted anew), all other columns as they were.

    A text of which nothing but white space is left goes, unless nothing was cut from it.
    """
    key = "_repeats_uid"

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            uid = np.zeros(batch.num_rows, np.int64)
            for first, last, data, offsets in slices(batch, "text"):
                uid[first:last] = _text_keys(ids.slice(first, last - first), data, offsets)
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(uid)], names=[*kept, key])

    others = T.StructType([f for f in docs.schema if f.name != "text"]).add(key, T.LongType())
    cut = remove_repeats(docs, length, with_text=True).select(F.col("uid").alias(key), "n_removed", "kept_text").dropDuplicates([key])
    out = docs.mapInArrow(keyed, others).join(cut, key).filter(~((F.col("n_removed") > 0) & (F.trim("kept_text") == ""))).withColumn("text", F.col("kept_text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
