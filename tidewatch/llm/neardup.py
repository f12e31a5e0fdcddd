"""MinHash near-dedup with SuperMinHash signatures.

Each element ranks the signature's slots by a random permutation, one slot per level; level j offers slot p_j the value
j + r. All values of a level are above those of the level before, so a document stops as soon as every slot is filled:
long documents need two or three levels. The ranks of one element are correlated, which lowers the variance of the
estimate below that of independent hashes. Signatures are banded; a bucket's members are tied to its smallest id, which
gives candidate groups without listing pairs; inside a group, links are confirmed on full shingle sets and joined by
union-find, and the confirmed ties of all groups are put together by distributed connected components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, lookup, mix, prefix_hash, range_hash, shingles, slices, words, written

#: Slots of a signature at most.
SLOTS = 252
#: Levels whose permutation is traced back through the swaps; beyond, the few documents left hold it in full.
TRACED = 5
#: Shingles of one block of a candidate group. Larger groups are cut into blocks and verified block against block.
BLOCK_SHINGLES = 2_000_000


def bands_for(similarity: float) -> tuple[int, int]:
    """(rows, bands) with a miss below 1e-5 for one link at the threshold and at most SLOTS slots."""
    for rows in range(12, 0, -1):
        bands = SLOTS // rows
        if (1 - similarity ** rows) ** bands < 1e-5:
            return rows, bands
    return 1, SLOTS


def _draw(hashes: np.ndarray, level: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(hashes + np.uint64((level * 0x9E3779B97F4A7C15 + 0x1234567) & 0xFFFFFFFFFFFFFFFF))
    k = level + (((x & np.uint64(0xFFFFFFFF)) * np.uint64(slots - level)) >> np.uint64(32)).astype(np.int64)
    return (x >> np.uint64(40)).astype(np.uint32) | np.uint32(level << 24), k


def superminhash(hashes: np.ndarray, offsets: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures (rows x slots, uint32: level and 24 random bits) of sets of 64-bit hashes. An empty set keeps the top value."""
    rows = len(offsets) - 1
    top = np.uint32(0xFFFFFFFF)
    out = np.full(rows * slots, top, np.uint32)
    size = np.diff(offsets)
    own = np.repeat(np.arange(rows), size)
    swaps: list[np.ndarray] = []
    table = None
    for level in range(slots):
        if not len(hashes):
            break
        value, k = _draw(hashes, level, slots)
        if level < TRACED:
            at = k
            for t in range(level - 1, -1, -1):
                at = np.where(at == t, swaps[t], np.where(at == swaps[t], t, at))
            swaps.append(k)
        else:
            each = np.arange(len(hashes))
            if table is None:
                table = np.broadcast_to(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.int32), (len(hashes), slots)).copy()
                for t, kt in enumerate(swaps):
                    moved = table[each, kt]
                    table[each, kt] = table[:, t]
                    table[:, t] = moved
            at = table[each, k].astype(np.int64)
            table[each, k] = table[:, level]
            table[:, level] = at
        np.minimum.at(out, own * slots + at, value)
        open_row = (out.reshape(rows, slots) == top).any(1)
        live = open_row[own]
        if not live.all():
            hashes, own = hashes[live], own[live]
            swaps = [s[live] for s in swaps]
            table = None if table is None else table[live]
    return out.reshape(rows, slots)


def band_keys(signatures: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """One 64-bit key for each band."""
    cut = signatures[:, :rows * bands].reshape(len(signatures), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(signatures), bands))
    for j in range(rows):
        key = mix(key + cut[:, :, j] * np.uint64(0xD6E8FEB86659FD93))
    return key.view(np.int64)


def _sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    start, end, row = words(data, offsets)
    return shingles(range_hash(prefix_hash(data, lower=True), start, end), row, len(offsets) - 1, size)


def _signed(size: int, rows: int, bands: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()),
                        ("bands", pa.list_(pa.int64())), ("packed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids = batch.column("doc_id")
            for first, last, data, offsets in slices(batch, "text"):
                sets, at = _sets(data, offsets, size)
                n = np.diff(at)
                keys = band_keys(superminhash(sets, at, rows * bands), rows, bands)
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(sets)])
                other = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets ^ np.uint64(0xA5A5A5A5A5A5A5A5)))])
                set_a, set_b = mix(total[at[1:]] - total[at[:-1]] + n.astype(np.uint64)), other[at[1:]] - other[at[:-1]]
                counts = np.where(n > 0, bands, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)),
                                                 pa.array(keys[n > 0].ravel()))
                packed = [packer.compress(data[offsets[i]:offsets[i + 1]].tobytes()) for i in range(last - first)]
                yield pa.RecordBatch.from_arrays([ids.slice(first, last - first), pa.array(n), pa.array(set_a.view(np.int64)),
                                                  pa.array(set_b.view(np.int64)), lists, pa.array(packed, pa.binary())], schema=schema)

    return run


def joined_sets(sets: list[np.ndarray], percent: int, first: int | None = None) -> np.ndarray:
    """Smallest index reachable for each set over links with 100 * intersection >= percent * union.

    A reached set is compared only with sets not reached yet; only lengths within the threshold of each other are.
    With ``first``, sets from that index on form a second block, and links inside a block are left out.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    values, flat = np.unique(np.concatenate(sets), return_inverse=True) if n else (None, np.zeros(0, np.int64))
    begin = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(len(values) if n else 0, bool)
    label = np.arange(n)
    side = np.zeros(n, bool) if first is None else np.arange(n) >= first
    left = np.arange(n)

    def near(i: int, left: np.ndarray) -> np.ndarray:
        """Members of ``left`` that are linked to set i."""
        fit = left[(100 * size[left] >= percent * size[i]) & (100 * size[i] >= percent * size[left])]
        if first is not None:
            fit = fit[side[fit] != side[i]]
        if not len(fit):
            return fit
        own = flat[begin[i]:begin[i + 1]]
        mark[own] = True
        lengths = size[fit]
        at = np.concatenate([[0], np.cumsum(lengths)])
        where = np.repeat(begin[fit] - at[:-1], lengths) + np.arange(at[-1])
        both = np.add.reduceat(mark[flat[where]].astype(np.int64), at[:-1])
        mark[own] = False
        return fit[100 * both >= percent * (size[i] + lengths - both)]

    while len(left):
        root, queue = left[0], [left[0]]
        left = left[1:]
        while queue and len(left):
            found = near(queue.pop(), left)
            if len(found):
                label[found] = root
                left = np.setdiff1d(left, found, assume_unique=True)
                queue += found.tolist()
    return label


def _verified(size: int, percent: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["side", "doc_id"]).drop_duplicates(["side", "doc_id", "set_a", "set_b"])
        unpack = zstandard.ZstdDecompressor()
        sets: list[np.ndarray] = []
        for text in group["packed"]:
            data = np.frombuffer(unpack.decompress(text), np.uint8)
            sets.append(_sets(data, np.array([0, len(data)]), size)[0])
        split = int((group["side"] == 0).sum())
        label = joined_sets(sets, percent, split if split < len(group) else None)
        ids = group["doc_id"].to_numpy()
        return pd.DataFrame({"u": ids, "v": ids[label]})

    return run


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row: groups of documents linked by shingle-set similarity.

    ``size`` words make a shingle; sets are linked when 100 * |both| >= percent * |either|. Equal sets are one class.
    A text without words (empty or null included) has an empty set and is linked with nothing. A null id is linked with
    nothing, has a null component and is kept. Rows that share an id count as one document and get the same component.
    Columns other than doc_id and text are not read.
    """
    rows, bands = bands_for(percent / 100)
    run = _signed(size, rows, bands)
    signed = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, packed binary"), "signatures")
    full = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = written(full.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("bands").alias("bands"),
                                                        F.first("n_shingles").alias("n_shingles")), "classes")
    banded = classes.select(F.col("rep").alias("u"), F.explode("bands").alias("band"))
    leaders = written(banded.groupBy("band").agg(F.min("u").alias("v"), F.count("*").alias("n")).filter("n > 1"), "leaders")
    candidate = components(lookup(banded, leaders, ["band"], "n").select("u", "v"))

    weighed = candidate.withColumnRenamed("node", "rep").join(classes.groupBy("rep").agg(F.max("n_shingles").alias("n_shingles")), "rep")
    # A group is cut into blocks of bounded size by a hash of the id; every pair of blocks meets once.
    cut = weighed.groupBy("root").agg(F.sum("n_shingles").alias("w")).select("root", F.ceil(F.col("w") / block_shingles).cast("long").alias("blocks"))
    placed = weighed.join(cut, "root").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    meets = placed.select("rep", "root", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct(
        F.least(o, F.col("block")).alias("low"), F.greatest(o, F.col("block")).alias("high"),
        (F.col("block") > o).cast("int").alias("side")))).alias("m")).select("rep", "root", "m.low", "m.high", "m.side")
    texts = full.select("doc_id", "set_a", "set_b", "packed").join(
        classes.select("set_a", "set_b", F.col("rep").alias("doc_id")), ["set_a", "set_b", "doc_id"])
    confirmed = texts.join(meets.withColumnRenamed("rep", "doc_id"), "doc_id").groupBy("root", "low", "high").applyInPandas(
        _verified(size, percent), "u long, v long")

    # An id that stands in several classes ties them; other copies need no edges, they follow their class.
    member = lookup(full.select("doc_id", "set_a", "set_b"), classes.select("set_a", "set_b", "rep", "n"), ["set_a", "set_b"], "n").select("doc_id", "rep")
    spread = member.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.count("*").alias("n")).filter("low != high")
    shared = lookup(member, written(spread, "shared-ids"), ["doc_id"], "n").select(F.col("rep").alias("u"), F.col("low").alias("v"))
    linked = components(confirmed.unionByName(shared).filter("u != v"))
    facts = written(classes.select("set_a", "set_b", "rep", "n").join(linked.withColumnRenamed("node", "rep"), "rep", "left").select(
        "set_a", "set_b", F.coalesce("root", "rep").alias("component_id"), "n"), "facts")
    found = lookup(full.select("doc_id", "n_shingles", "set_a", "set_b"), facts, ["set_a", "set_b"], "n").select("doc_id", "n_shingles", "component_id")
    # A row without words takes the component of a row with its id and words, if there is one.
    bare = signed.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles")
    known = found.join(bare.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    rest = bare.join(known, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return found.unionByName(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
