"""Paired signed-rank tests, one per group of a table of any size.

Under the null hypothesis every rank has either sign, so the rank sum's generating polynomial is the product of (1 + x^r) / 2
over all ranks. Small groups multiply it out in one row. For larger ones the product is evaluated at roots of unity instead,
where it is a sum of logarithms that merges over any number of tasks, and the inverse transform gives shares and tails. Away
from a few frequencies the product is below 1e-17 / cells; these are ruled out by bounds over whole intervals.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.portable import reading
from ..shared import written
from .ordered import counted_quantiles, null_safe_join, range_cuts, running, with_range_bucket

ZERO = 1e-8
TIE_DIGITS = 8
#: Differences are added up as decimals, whose sums don't depend on the order of rows. Sums from 1e16 on stay doubles.
EXACT = "decimal(38,22)"
#: Groups with up to so many ranks are folded in one row, of at most FOLD_RANKS * (FOLD_RANKS + 1) + 1 cells.
FOLD_RANKS = 64
#: Groups with up to so many ranks have their whole distribution listed; no share of it is below the smallest double.
LISTED_RANKS = 1024
#: Ranks, frequencies or cells of one numpy block.
CHUNK = 512
#: Intervals that are bounded together, frequencies that are summed together, and cells of one row.
INTERVALS, WAVES, SPAN = 1 << 13, 1 << 12, 1 << 16
#: Products below this part of 1 / cells don't count.
NOTHING = 1e-17


def differences(df: DataFrame, x: str, y: str, keep: list[str] = ()) -> DataFrame:
    """Non-zero paired differences; gaps up to 1e-8 count as zero, pairs with a null or NaN reading as no pair."""
    return df.select(*keep, (reading(x) - reading(y)).alias("difference")).where(F.abs("difference") > ZERO)


def _exact_sum(parts: str) -> Column:
    """Sum of decimals; null where it, or any part of it, is out of their range."""
    return F.when(F.count(parts) == F.count(F.lit(1)), F.try_sum(parts))


def average_ranks(diffs: DataFrame, by: list[str], cuts: list[float] | None = None, count: Column | None = None,
                  exact: str | None = None) -> DataFrame:
    """Average rank of |difference| per group, one row per distinct size with its sign counts.

    Equal sizes are merged before the shuffle, and ranks follow from two-level
    running counts, so a hot group never sits in one task. ``count`` says for how
    many pairs a row stands, one by default; ``exact`` names a column with the
    sum of their differences as a decimal, which is then summed too.
    """
    c = F.lit(1) if count is None else count
    sized = diffs.withColumns({"size": F.round(F.abs("difference"), TIE_DIGITS), "_c": c})
    merged = with_range_bucket(sized, "size", cuts=cuts).groupBy(*by, "_bucket", "size").agg(
        F.sum("_c").alias("n"), F.sum(F.when(F.col("difference") > 0, F.col("_c")).otherwise(0)).alias("n_plus"),
        F.sum(F.col("difference") * F.col("_c")).alias("total"), *([_exact_sum(exact).alias(exact)] if exact else []))
    placed = running(merged, by, ["size"], {"upto": ("sum", F.col("n"))}, whole=True)
    return placed.withColumn("rank", F.col("upto") - F.col("n") + (F.col("n") + 1) / 2.0).drop("_bucket")


def null_distribution(doubled_ranks: str | Column) -> Column:
    """Share of all sign patterns per doubled rank sum, index 0..2*sum, as an array of doubles.

    Equals listing all 2^n patterns, but folds one rank at a time. For lists of
    bounded length; ``null_shares`` takes groups of any size.
    """
    ranks = F.col(doubled_ranks) if isinstance(doubled_ranks, str) else doubled_ranks
    top = F.aggregate(ranks, F.lit(0), lambda a, r: a + r)
    start = F.transform(F.sequence(F.lit(0), top), lambda i: F.when(i == 0, 1.0).otherwise(0.0))
    return F.aggregate(ranks, start, lambda acc, r: F.transform(
        acc, lambda v, i: (v + F.when(i >= r, F.get(acc, i - r)).otherwise(0.0)) / F.lit(2.0)))


def _folded(ranks: DataFrame, by: list[str]) -> DataFrame:
    """(by, _dist): the null distribution of each small group, in one row."""
    small = ranks.where(F.col("upto_whole") <= FOLD_RANKS)
    listed = F.flatten(F.collect_list(F.array_repeat((F.col("rank") * 2).cast("int"), F.col("n").cast("int"))))
    return small.groupBy(*by).agg(listed.alias("_r")).select(*by, null_distribution("_r").alias("_dist"))


def _grid(ranks: DataFrame, by: list[str]) -> DataFrame:
    """One row per large group: _unit (1 or 2: doubled ranks have this factor), _sum, _cells, _top, _chunks, _spread of its ranks."""
    r, n = F.col("rank") * 2, F.col("n")
    per = ranks.where(F.col("upto_whole") > FOLD_RANKS).groupBy(*by).agg(
        F.when(F.max(r.cast("bigint") % 2) == 0, 2).otherwise(1).cast("bigint").alias("_unit"), F.sum(r.cast("bigint") * n).alias("_s"),
        F.max(r.cast("bigint")).alias("_m"), F.ceil(F.count(F.lit(1)) / CHUNK).alias("_chunks"), F.sqrt(F.sum(r * r * n)).alias("_d"))
    return per.select(*by, "_unit", F.expr("_s div _unit").alias("_sum"), F.expr("_s div _unit + 1").alias("_cells"),
                      F.expr("_m div _unit").alias("_top"), "_chunks", (F.col("_d") / 2 / F.col("_unit")).alias("_spread"))


def _arrow(df: DataFrame, by: list[str], fn, fields: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    """``fn`` of each row's columns gives equally long arrays, one per field; they become rows beside the group's columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                got = fn({c: batch.column(c)[i] for c in batch.schema.names})
                if len(got[0]):
                    keys = batch.select(by).slice(i, 1).take(pa.array(np.zeros(len(got[0]), np.int64))) if by else None
                    columns = [keys.column(b) for b in by] + [pa.array(g, kind) for g, (_, _, kind) in zip(got, fields)]
                    yield pa.RecordBatch.from_arrays(columns, [*by, *(f for f, _, _ in fields)])

    out = T.StructType([df.schema[b] for b in by])
    for name, kind, _ in fields:
        out = out.add(name, kind)
    return df.mapInArrow(run, out)


def _tasks(df: DataFrame) -> int:
    """Blocks are few and costly, so they aren't packed by bytes."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _numbers(x) -> np.ndarray:
    return x.values.to_numpy(zero_copy_only=False)


def _standing(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """(first frequency, frequencies) of the intervals of a block that a bound over some of the ranks doesn't rule out.

    Interval i holds the angles (i .. i+1) * pi / parts. Over it no factor |cos(angle * r / 2)| exceeds the cosine of the distance
    from the nearest multiple of pi to the nearer end.
    """
    parts, cells = 4 * row["_top"].as_py(), row["_cells"].as_py()
    first = row["_block"].as_py() * INTERVALS
    i = np.arange(first, min(parts, first + INTERVALS))
    r, n = _numbers(row["_r"]), _numbers(row["_n"])
    mixed = np.random.default_rng(len(r)).permutation(len(r))
    r, n = r[mixed], n[mixed]
    # Few ranks rule out most intervals; only the rest is bounded with more of them.
    bound, at, step = np.zeros(len(i)), 0, 8
    while at < len(r) and len(i):
        some = r[at:at + step]
        part = ((2 * i[:, None] + 1) * some % (4 * parts)) / (4.0 * parts)
        off = np.maximum(0.0, np.minimum(part, 1.0 - part) - some / (4.0 * parts))
        with np.errstate(divide="ignore"):
            bound = bound + np.log(np.cos(np.pi * off)) @ n[at:at + step]
        left = bound >= np.log(NOTHING / cells)
        i, bound, at, step = i[left], bound[left], at + step, min(2 * step, CHUNK)
    # Frequency k is in interval (2 * parts * k) // cells; integers may pass 64 bits.
    low = np.array([-(-int(x) * cells // (2 * parts)) for x in i], np.int64)
    end = np.array([-(-(int(x) + 1) * cells // (2 * parts)) for x in i], np.int64)
    low, end = np.maximum(low, 1), np.minimum(end, (cells - 1) // 2 + 1)
    low, end = low[low < end], end[low < end]
    apart = low[1:] != end[:-1]     # neighbouring intervals go together
    low, end = low[np.append(True, apart)[:len(low)]], end[np.append(apart, True)[-len(end):]] if len(end) else end
    pieces = np.maximum(0, -(-(end - low) // CHUNK))
    start = np.repeat(low, pieces) + CHUNK * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    return start, np.minimum(CHUNK, np.repeat(end, pieces) - start)


def _factors(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(frequency, log of the product's size, sign flips) over the ranks of one chunk, at the frequencies of one block."""
    cells, k0 = row["_cells"].as_py(), row["_from"].as_py()
    k = np.arange(k0, k0 + row["_k_count"].as_py())
    r, n = _numbers(row["_r"]), _numbers(row["_n"])
    value = np.cos(np.pi * (k[:, None] * r % (2 * cells) / float(cells)))
    with np.errstate(divide="ignore"):
        size = np.maximum(np.log(np.abs(value)), -1e6) @ n
    return k, size, (value < 0).astype(np.int64) @ (n.astype(np.int64) % 2)


def transform(ranks: DataFrame, by: list[str]) -> DataFrame:
    """(by, the grid of ``_grid``, _k, _phi): the centred rank-sum polynomial of every large group at the frequencies that count."""
    grid = _grid(ranks, by)
    unit = null_safe_join(ranks, grid.select(*by, "_unit", "_chunks"), by).withColumn("_r", ((F.col("rank") * 2).cast("bigint") / F.col("_unit")).cast("bigint"))
    chunks = unit.withColumn("_chunk", F.pmod(F.xxhash64("_r"), "_chunks")).groupBy(*by, "_chunk").agg(
        F.sort_array(F.collect_list(F.struct("_r", F.col("n").cast("double").alias("_n")))).alias("_l")).select(
        *by, "_chunk", F.col("_l._r").alias("_r"), F.col("_l._n").alias("_n"))
    chunks = written(chunks, "rank-chunks")
    parts = grid.select(*by, "_top", "_cells", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(4 * _top - 1) div {INTERVALS}"))).alias("_block"))
    # Any part of the ranks gives a bound; the first chunk that holds any is a fair sample.
    sample = chunks.groupBy(*by).agg(F.min_by(F.struct("_r", "_n"), "_chunk").alias("_s")).select(*by, "_s._r", "_s._n")
    asked = null_safe_join(parts, sample, by).repartition(_tasks(ranks), *by, "_block")
    standing = _arrow(asked, by, _standing, [("_from", "long", pa.int64()), ("_k_count", "long", pa.int64())])
    work = null_safe_join(null_safe_join(standing, chunks, by), grid.select(*by, "_cells"), by)
    factors = _arrow(work.repartition(_tasks(ranks), *by, "_from", "_chunk"), by, _factors, [("_k", "long", pa.int64()), ("_size", "double", pa.float64()), ("_flips", "long", pa.int64())])
    phi = factors.groupBy(*by, "_k").agg((F.exp(F.sum("_size")) * F.when(F.sum("_flips") % 2 == 0, 1.0).otherwise(-1.0)).alias("_phi"))
    return null_safe_join(phi, grid, by)


def _turn(k: str, times: Column) -> Column:
    """pi * k * times / _cells, reduced by whole turns in integers first."""
    exact = F.col(k).cast("decimal(19,0)") * times.cast("decimal(18,0)")
    return F.pmod(exact, (F.col("_cells") * 2).cast("decimal(38,0)")).cast("double") * F.lit(np.pi) / F.col("_cells")


def two_sided(ranks: DataFrame, by: list[str], sums: DataFrame) -> DataFrame:
    """(by, p_value) of the large groups in ``sums`` (by, statistic): the exact share of sign patterns at least as far out.

    Absolute error below 1e-12; no row or task holds a group.
    """
    held = null_safe_join(transform(ranks, by), sums.select(*by, "statistic"), by)
    w = (F.col("statistic") * 2 / F.col("_unit")).cast("bigint")
    wave = F.sin(_turn("_k", w * 2 - F.col("_sum") + 1)) / F.sin(F.lit(np.pi) * F.col("_k") / F.col("_cells"))
    tails = held.groupBy(*by).agg(F.max(F.when(w * 2 >= F.col("_sum"), 1).otherwise(0)).alias("_all"),
                                  (F.max((w + 1) / F.col("_cells")) + F.sum(F.col("_phi") * wave / F.col("_cells"))).alias("_p"))
    return tails.select(*by, F.when(F.col("_all") == 1, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_p") * 2))).alias("p_value"))


def _times(a: np.ndarray, b: np.ndarray, whole: int) -> np.ndarray:
    """a * b modulo ``whole``, for products that may pass 64 bits."""
    high, low = a >> 20, a & ((1 << 20) - 1)
    return ((high * b % whole << 20) + low * b) % whole


def _reached(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block of SPAN cells, first, last) of the runs of cells of one group that some sign pattern reaches, cut where blocks end."""
    low, high = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for r, left in zip(_numbers(row["_r"]).tolist(), _numbers(row["_n"]).astype(np.int64).tolist()):
        # Equal ranks in lots of 1, 2, 4 and so on, and the rest: every number of them is a sum of lots.
        lot = 1
        while left:
            shift, left, lot = r * min(lot, left), left - min(lot, left), 2 * lot
            first, last = np.concatenate([low, low + shift]), np.concatenate([high, high + shift])
            order = np.argsort(first, kind="stable")
            first, last = first[order], np.maximum.accumulate(last[order])
            apart = first[1:] > last[:-1] + 1
            low, high = first[np.append(True, apart)], last[np.append(apart, True)]
    pieces = high // SPAN - low // SPAN + 1
    block = np.repeat(low // SPAN, pieces) + np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return block * SPAN, np.maximum(np.repeat(low, pieces), block * SPAN), np.minimum(np.repeat(high, pieces), (block + 1) * SPAN - 1)


def _shares(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """(doubled rank sum, part of its share above ``_over``) from the frequencies of one block, for the cells that are reached in one row.

    The angle of a cell is that of its stretch of CHUNK cells plus that of its place in it, so sines and cosines are taken by stretch
    and by place and only multiplied by cell.
    """
    cells, total = row["_cells"].as_py(), row["_sum"].as_py()
    runs = row["_runs"].values
    starts, ends = (runs.field(c).to_numpy(zero_copy_only=False) for c in ("_first", "_last"))
    first, count = int(starts.min()), int(ends.max() - starts.min()) + 1
    k, phi = _numbers(row["_ks"]), _numbers(row["_phis"])
    stretch = np.pi * _times(2 * np.arange(first, first + count, CHUNK)[:, None] - total, k, 2 * cells) / float(cells)
    place = np.pi * _times(2 * np.arange(min(CHUNK, count))[:, None], k, 2 * cells) / float(cells)
    part = (phi * np.cos(stretch)) @ np.cos(place).T - (phi * np.sin(stretch)) @ np.sin(place).T
    part = (2.0 * part.ravel()[:count] + 1.0 / row["_lots"].as_py()) / cells
    turns = np.zeros(count + 1, np.int64)
    turns[starts - first] += 1
    turns[ends - first + 1] -= 1
    kept = np.flatnonzero((np.cumsum(turns[:-1]) > 0) & (part > row["_over"].as_py()))
    return (first + kept) * row["_unit"].as_py(), part[kept]


def _listed(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """(doubled rank sum, share) of one group whose doubled ranks are listed: halved sums, one rank at a time, as ``null_distribution``."""
    ranks = np.repeat(_numbers(row["_r"]), _numbers(row["_n"]))
    share, top = np.zeros(int(ranks.sum()) + 1), 0
    share[0] = 1.0
    for r in ranks.tolist():
        share[r:top + r + 1] += share[:top + 1].copy()
        top += r
        share[:top + 1] /= 2.0
    found = np.flatnonzero(share)
    return found, share[found]


def null_shares(ranks: DataFrame, by: list[str], least: float = 0.0) -> DataFrame:
    """(by, doubled, share): every doubled rank sum that some sign pattern reaches, with its share of all of them above ``least``, for
    groups of any size.

    Shares of groups with more than LISTED_RANKS ranks are right within 1e-15; smaller ones are 0.0 there, or left out with a
    ``least``. What such a group reaches is found in one task, as runs of cells.
    """
    ranks = written(ranks, "ranks")
    fields = [("doubled", "long", pa.int64()), ("share", "double", pa.float64())]
    doubled = F.struct((F.col("rank") * 2).cast("bigint").alias("_r"), F.col("n").cast("bigint").alias("_n"))
    listed = ranks.where(F.col("upto_whole") <= LISTED_RANKS).groupBy(*by).agg(F.sort_array(F.collect_list(doubled)).alias("_l"))
    small = _arrow(listed.select(*by, F.col("_l._r").alias("_r"), F.col("_l._n").alias("_n")), by, _listed, fields).where(F.col("share") > least)
    large = ranks.where(F.col("upto_whole") > LISTED_RANKS)
    if large.isEmpty():
        return small
    over = max(least, 1e-15) if least else -1.0
    # All products up to NOTHING together change no share by more than NOTHING.
    phi = written(transform(large, by).where(F.abs("_phi") > NOTHING), "rank-waves")
    grid = phi.groupBy(*by).agg(*[F.max(c).alias(c) for c in ("_unit", "_sum", "_cells", "_spread")], F.sum(F.abs("_phi")).alias("_most"),
                                F.ceil(F.count(F.lit(1)) / WAVES).alias("_lots"))
    grid = grid.where((F.col("_most") * 2 + 1) / F.col("_cells") > over)
    waves = null_safe_join(phi.select(*by, "_k", "_phi"), grid.select(*by, "_lots"), by).withColumn("_block", F.pmod(F.xxhash64("_k"), "_lots")).groupBy(*by, "_block").agg(F.collect_list(F.struct("_k", "_phi")).alias("_l")).select(
        *by, "_block", F.col("_l._k").alias("_ks"), F.col("_l._phi").alias("_phis"))
    # A share t spreads from the middle is at most exp(-t * t / 2).
    reach = math.sqrt(-2 * math.log(max(least, 1e-15))) * F.col("_spread") + 1
    low = F.greatest(F.lit(0), F.floor(F.col("_sum") / 2 - reach)).cast("bigint")
    high = F.least(F.col("_sum"), F.ceil(F.col("_sum") / 2 + reach)).cast("bigint")
    scaled = F.struct(F.expr("CAST(rank * 2 AS BIGINT) div _unit").alias("_r"), F.col("n").cast("bigint").alias("_n"))
    held = null_safe_join(large, grid.select(*by, "_unit"), by).groupBy(*by).agg(F.sort_array(F.collect_list(scaled)).alias("_l"))
    held = held.select(*by, F.col("_l._r").alias("_r"), F.col("_l._n").alias("_n")).repartition(_tasks(ranks), *by)
    runs = _arrow(held, by, _reached, [(c, "long", pa.int64()) for c in ("_s0", "_first", "_last")])
    runs = null_safe_join(runs, grid.withColumns({"_low": low, "_high": high}), by)
    runs = written(runs.withColumn("_far", (F.col("_s0") > F.col("_high")) | (F.col("_s0") + SPAN <= F.col("_low"))), "rank-runs")
    blocks = runs.where("NOT _far").groupBy(*by, "_unit", "_sum", "_cells", "_lots", "_s0").agg(F.collect_list(F.struct("_first", "_last")).alias("_runs"))
    # Where one block holds all frequencies, what is below ``least`` goes in the task.
    work = null_safe_join(blocks, waves, by).withColumn("_over", F.when(F.col("_lots") == 1, F.lit(over)).otherwise(float("-inf")))
    work = written(work, "rank-cells")
    at_once, by_lots = (_arrow(work.where(which).repartition(4 * _tasks(ranks), *by, "_s0", "_block"), by, _shares, fields) for which in ("_lots = 1", "_lots > 1"))
    found = at_once.unionByName(by_lots.groupBy(*by, "doubled").agg(F.sum("share").alias("share")).where(F.col("share") > over))
    if not least:
        far = runs.where("_far").repartition(4 * _tasks(ranks), *by, "_s0").select(*by, "_unit", F.explode(F.sequence("_first", "_last")).alias("_s"))
        found = found.unionByName(far.select(*by, (F.col("_s") * F.col("_unit")).alias("doubled"), F.lit(0.0).alias("share")))
    return small.unionByName(found.withColumn("share", F.greatest("share", F.lit(0.0))))


def _upper_normal_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0 by the published polynomial approximation 26.2.17 (error below 7.5e-8)."""
    # Coefficients of the approximation.
    p, b = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(p) * z)
    poly = t * (F.lit(b[0]) + t * (F.lit(b[1]) + t * (F.lit(b[2]) + t * (F.lit(b[3]) + t * F.lit(b[4])))))
    return F.lit(0.3989422804014327) * F.exp(-z * z / F.lit(2.0)) * poly


def signed_rank_test(df: DataFrame, by: list[str], x: str, y: str, method: str = "exact") -> DataFrame:
    """w+, w-, statistic, p-value, significance, direction, mean and median difference per group.

    ``method`` is ``exact``, for groups of every size, or ``normal``, the
    approximation with tie-corrected variance. Groups without any difference
    report n = 0 and p = 1. The table is read once, for the number of pairs by
    group and difference; everything else follows from these counts. Neither
    mean nor direction depends on the order of rows or tasks.
    """
    if method not in ("exact", "normal"):
        raise ValueError(f"unknown method {method!r}")
    d = reading(x) - reading(y)
    counts = df.select(*by, F.when(F.abs(d) > ZERO, d).alias("difference")).groupBy(*by, "difference").agg(
        F.count(F.lit(1)).alias("_pairs"), F.try_sum(F.col("difference").try_cast(EXACT)).alias("_exact"))
    counts = written(counts, "differences")
    found = counts.where(F.col("difference").isNotNull())
    # Quantiles of the differences also cut their sizes well, so one pass finds both sets of range buckets.
    cuts = range_cuts(found, ["difference"])["difference"]
    ranks = average_ranks(found, by, sorted({abs(c) for c in cuts}), F.col("_pairs"), "_exact")
    if method == "exact":
        ranks = written(ranks, "ranks")
    medians = counted_quantiles(found, by, "difference", "_pairs", {"median_difference": 0.5}, cuts=cuts)
    sums = ranks.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum(F.col("rank") * F.col("n_plus")).alias("w_plus"),
        F.sum(F.col("rank") * (F.col("n") - F.col("n_plus"))).alias("w_minus"),
        F.coalesce(_exact_sum("_exact").cast("double"), F.sum("total")).alias("_total"), F.sum(F.col("n") * F.col("n") * F.col("n") - F.col("n")).alias("_ties"))
    sums = sums.withColumn("statistic", F.least("w_plus", "w_minus"))
    if method == "exact":
        tested = _with_exact_p(ranks, by, sums)
    else:
        m = F.col("n").cast("double")
        spread = F.sqrt(m * (m + 1) * (2 * m + 1) / 24 - F.col("_ties") / 48.0)
        z = F.abs(F.try_divide(F.col("statistic") - m * (m + 1) / 4, spread))
        tested = sums.withColumn("p_value", F.least(F.lit(1.0), F.lit(2.0) * _upper_normal_tail(z)))
    tested = tested.withColumn("mean_difference", F.col("_total") / F.col("n"))
    tested = null_safe_join(tested, medians, by)
    kept = ["n", "w_plus", "w_minus", "statistic", "p_value", "mean_difference", "median_difference"]
    groups = counts.select(*by).distinct() if by else df.sparkSession.range(1).select()
    tested = null_safe_join(groups, tested.select(*by, *kept), by, "left")
    zero = F.lit(0.0)
    full = tested.select(*by, F.coalesce("n", F.lit(0)).alias("n"),
                         *[F.coalesce(c, F.lit(1.0) if c == "p_value" else zero).alias(c) for c in kept[1:]])
    way = (F.when(F.col("mean_difference") > 0, "better_than_random")
           .when(F.col("mean_difference") < 0, "worse_than_random").otherwise("no_difference"))
    return full.withColumns({"significant": F.col("p_value") < 0.05, "direction": way})


def _with_exact_p(ranks: DataFrame, by: list[str], sums: DataFrame) -> DataFrame:
    top = F.size("_dist") - 1
    tail = F.aggregate(F.transform("_dist", lambda c, i: F.when(
        F.least(i, top - i) <= F.col("statistic") * 2 + 1e-12, c).otherwise(0.0)), F.lit(0.0), lambda a, v: a + v)
    small = null_safe_join(sums.where(F.col("n") <= FOLD_RANKS), _folded(ranks, by), by).withColumn("p_value", tail).drop("_dist")
    if ranks.where(F.col("upto_whole") > FOLD_RANKS).isEmpty():
        return small
    return small.unionByName(null_safe_join(sums.where(F.col("n") > FOLD_RANKS), two_sided(ranks, by, sums), by))
