"""Many fits in the scans of one.

A fit is a weight column: zero where a row takes no part, so folds, seeds, data sets and class weights are all columns of one
table. Linear models sum gradient and curvature of every fit in one pass a step; trees sum the histograms of every tree of every
fit in one pass a level, so two thousand trees cost five passes; Bayes models need one pass. Only these sums, whose size depends
on features, fits and trees and never on rows, leave the tasks.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

# The functions of the passes travel to the workers by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Histogram cells of one pass; more trees than fit take several passes a level.
CELLS = 1 << 23
_ROWS = 1 << 15


def _columns(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Rows x names, missing as NaN."""
    return np.stack([batch.column(n).cast(pa.float64()).to_numpy(zero_copy_only=False) for n in names], 1) if names else np.zeros((batch.num_rows, 0))


def _totals(df: DataFrame, names: list[str], shape: tuple[int, ...], of: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """Sum of ``of`` over all batches, an array of ``shape``."""
    size = int(np.prod(shape))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += of(batch).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["at", "v"])

    out = np.zeros(size)
    for at, v in df.select(*names).mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v")).collect():
        out[at] = v
    return out.reshape(shape)


def _scored(df: DataFrame, name: str, needed: list[str], score: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """``df`` with one more DOUBLE column."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score(batch.select(needed)))], [*batch.schema.names, name])

    return df.mapInArrow(run, schema)


# ---------------------------------------------------------------- linear models

@dataclass
class Linear:
    features: list[str]
    coefficients: np.ndarray    # fits x features, for plain readings
    intercepts: np.ndarray
    gradient: np.ndarray        # largest part of the mean loss's gradient, by fit, over standardised readings
    passes: int

    def score(self, df: DataFrame, which: str, name: str = "score") -> DataFrame:
        """P(class 1), or the margin on the logistic curve, by the fit that ``which`` numbers; an expression in the JVM."""
        at = F.col(which) + 1
        pick = lambda v: F.element_at(F.array(*[F.lit(float(x)) for x in v]), at.cast("int"))
        margin = pick(self.intercepts)
        for j, f in enumerate(self.features):
            margin = margin + pick(self.coefficients[:, j]) * F.col(f).cast("double")
        return df.withColumn(name, F.lit(1.0) / (F.lit(1.0) + F.exp(-margin)))


def _moments(df: DataFrame, features: list[str], weights: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, mean, sample deviation) of every fit's rows; a constant feature has deviation 1."""
    k, d = len(weights), len(features)

    def of(batch: pa.RecordBatch) -> np.ndarray:
        x, on = _columns(batch, features), _columns(batch, weights) > 0
        return np.concatenate([on.sum(0)[:, None], on.T @ x, on.T @ (x * x)], 1)

    sums = _totals(df, [*features, *weights], (k, 1 + 2 * d), of)
    if np.isnan(sums).any():
        raise ValueError("a feature is missing or NaN")
    n, mean = sums[:, :1], sums[:, 1:d + 1] / np.maximum(sums[:, :1], 1)
    spread = np.sqrt(np.maximum(0.0, sums[:, d + 1:] - n * mean * mean) / np.maximum(n - 1, 1))
    return n[:, 0], mean, np.where(spread > 1e-12 * (1 + np.abs(mean)), spread, 1.0)


def fit_linear(df: DataFrame, features: list[str], label: str, weights: list[str], loss: str = "logistic", ridge: float | list[float] = 0.0, tol: float = 1e-9,
               steps: int = 100) -> Linear:
    """Newton's method on the mean ``logistic`` or ``squared_hinge`` loss, for all weight columns together.

    ``ridge``, one for all or one of each fit, is on standardised coefficients, as half the squared length; the intercept goes free. A step that doesn't lower a
    fit's loss is shortened for that fit alone.
    """
    k, d = len(weights), len(features)
    _, mean, spread = _moments(df, features, weights)
    free = np.append(np.ones(d), 0.0)
    ridge = np.broadcast_to(np.asarray(ridge, float), (k,))

    def derivatives(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        def of(batch: pa.RecordBatch) -> np.ndarray:
            x, y, w = _columns(batch, features), _columns(batch, [label])[:, 0], _columns(batch, weights)
            out = np.zeros((k, 2 + (d + 1) + (d + 1) ** 2))
            for m in range(k):
                on = w[:, m] > 0
                z = np.concatenate([(x[on] - mean[m]) / spread[m], np.ones((on.sum(), 1))], 1)
                v, t, eta = w[on, m], y[on], z @ b[m]
                if loss == "logistic":
                    p = np.where(eta >= 0, 1 / (1 + np.exp(-np.abs(eta))), np.exp(-np.abs(eta)) / (1 + np.exp(-np.abs(eta))))
                    value, first, second = np.logaddexp(0, eta) - t * eta, p - t, p * (1 - p)
                else:
                    side = 2 * t - 1
                    gap = np.maximum(0.0, 1 - side * eta)
                    value, first, second = gap * gap, -2 * side * gap, 2.0 * (gap > 0)
                out[m, 0], out[m, 1] = v.sum(), (v * value).sum()
                out[m, 2:d + 3] = z.T @ (v * first)
                out[m, d + 3:] = ((z * (v * second)[:, None]).T @ z).ravel()
            return out

        sums = _totals(df, [*features, label, *weights], (k, 2 + (d + 1) + (d + 1) ** 2), of)
        total = np.maximum(sums[:, :1], 1e-300)
        value = sums[:, 1] / total[:, 0] + ridge / 2 * (b * b * free).sum(1)
        return value, sums[:, 2:d + 3] / total + ridge[:, None] * b * free, (sums[:, d + 3:] / total).reshape(k, d + 1, d + 1) + ridge[:, None, None] * np.diag(free)

    b, size = np.zeros((k, d + 1)), np.ones(k)
    value, first, second = derivatives(b)
    passes = 2
    for _ in range(steps):
        open_ = (np.abs(first).max(1) > tol) & (size > 1e-6)
        if not open_.any():
            break
        step = np.stack([np.linalg.lstsq(second[m] + 1e-12 * np.eye(d + 1), first[m], rcond=None)[0] for m in range(k)])
        tried = np.where(open_[:, None], b - size[:, None] * step, b)
        new = derivatives(tried)
        passes += 1
        lower = open_ & (new[0] <= value + 1e-13 * (1 + np.abs(value)))
        b[lower], value[lower], first[lower], second[lower] = tried[lower], new[0][lower], new[1][lower], new[2][lower]
        size = np.where(lower, np.minimum(1.0, size * 4), size / 4)
    plain = b[:, :d] / spread
    return Linear(features, plain, b[:, d] - (plain * mean).sum(1), np.abs(first).max(1), passes)


# ---------------------------------------------------------------- trees

def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(16)])
#: The same limits for draws of 53 bits.
_DRAWS = np.array([math.ceil(p * (1 << 53)) for p in _POISSON.tolist()], np.uint64)


def _times(h: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often one tree draws each row: Poisson(1) by a hash of seed, tree and row."""
    salt = _mix(np.array([tree], np.uint64) + np.uint64((seed * 1_000_003) & 0xFFFFFFFF))
    draw = _mix(h ^ salt) >> np.uint64(11)
    out = np.zeros(len(h), np.uint8)
    for limit in _DRAWS[:4]:
        out += draw >= limit
    often = np.flatnonzero(out == 4)
    out[often] = np.searchsorted(_DRAWS, draw[often], "right")
    return out


@dataclass
class Trees:
    """Members are trees of fits, fit by fit; nodes are numbered as in a heap."""
    features: list[str]
    edges: list[np.ndarray]     # of each feature; a reading's bin is the number of edges below it
    trees: int                  # of each fit
    feature: np.ndarray         # members x nodes, -1 at a leaf
    cut: np.ndarray             # bins up to this one go left
    share: np.ndarray           # of class 1
    gain: np.ndarray
    rows: np.ndarray            # weight of a node

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Bins, features x rows."""
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)])

    def descend(self, codes: np.ndarray, member: int, rows: np.ndarray, levels: int) -> np.ndarray:
        """Node of each of ``rows`` in one member after some levels, or the leaf above where it stopped."""
        flat, wide, feature, cut = codes.ravel(), codes.shape[1], self.feature[member].astype(np.int64), self.cut[member]
        inner, start, node = feature >= 0, np.maximum(feature, 0) * wide, np.zeros(len(rows), np.int64)
        for _ in range(levels):
            down = 2 * node + 1 + (flat.take(start.take(node) + rows) > cut.take(node))
            node = down if inner.take(node).all() else np.where(inner.take(node), down, node)
        return node

    def score(self, df: DataFrame, which: str, name: str = "score") -> DataFrame:
        """Mean share of class 1 over the trees of the fit that ``which`` numbers."""
        depth = int(math.log2(self.feature.shape[1] + 1)) - 1

        def score(batch: pa.RecordBatch) -> np.ndarray:
            codes, fit = self.codes(_columns(batch, self.features)), _columns(batch, [which])[:, 0].astype(np.int64)
            out = np.zeros(len(fit))
            for f in np.unique(fit):
                rows = np.flatnonzero(fit == f)
                for member in range(f * self.trees, (f + 1) * self.trees):
                    out[rows] += self.share[member].take(self.descend(codes, member, rows, depth))
            return out / self.trees

        return _scored(df, name, [*self.features, which], score)


def even_edges(df: DataFrame, features: list[str], bins: int = 32) -> list[np.ndarray]:
    """Approximate quantiles as bin edges."""
    found = df.select(*[F.col(f).cast("double").alias(f) for f in features]).approxQuantile(features, [i / bins for i in range(1, bins)], 0.1 / bins)
    return [np.unique(e) for e in found]


def fit_trees(df: DataFrame, features: list[str], label: str, row_id: str, weights: list[str], trees: int = 1, depth: int = 5, bins: int = 32,
              seed: int = 42, edges: list | None = None) -> Trees:
    """Gini trees of every weight column, all grown together level by level.

    One tree sees every row and feature. Several draw each row a Poisson(1) number of times, by a hash of seed, tree and row id, and
    try the square root of the features at each node. Equal gains go to the first feature and the lowest cut. ``edges`` defaults to
    approximate quantiles over all rows of ``df``, which hold nothing of the label.
    """
    edges = [np.asarray(e, float) for e in (edges or even_edges(df, features, bins))]
    k, d, width = len(weights), len(features), max((len(e) for e in edges), default=0) + 1
    members, nodes = k * trees, 2 ** (depth + 1) - 1
    grown = Trees(features, edges, trees, np.full((members, nodes), -1, np.int16), np.zeros((members, nodes), np.int16), np.zeros((members, nodes)),
                  np.zeros((members, nodes)), np.zeros((members, nodes)))
    hashed = df.select(*features, label, *weights, F.xxhash64(row_id).alias("_h"))
    tried = max(1, math.ceil(math.sqrt(d))) if trees > 1 else d
    for level in range(depth):
        first, wide = 2 ** level - 1, 2 ** level
        live = np.arange(members) if level == 0 else np.flatnonzero((grown.feature[:, (first - 1) // 2:first] >= 0).any(1))
        lot = max(1, CELLS // (wide * d * width * 2))
        for at in range(0, len(live), lot):
            for r in _level(hashed, grown, label, weights, live[at:at + lot], level, width, tried, seed).collect():
                e, node = r["member"], first + r["node"]
                grown.share[e, node], grown.rows[e, node] = r["positive"] / r["rows"], r["rows"]
                if r["gain"] > 1e-12:
                    grown.feature[e, node], grown.cut[e, node], grown.gain[e, node] = r["feature"], r["cut"], r["gain"]
                    for child, n, pos in ((2 * node + 1, r["left"], r["left_positive"]), (2 * node + 2, r["rows"] - r["left"], r["positive"] - r["left_positive"])):
                        grown.share[e, child], grown.rows[e, child] = pos / n, n
    return grown


def _level(df: DataFrame, grown: Trees, label: str, weights: list[str], members: np.ndarray, level: int, width: int, tried: int, seed: int) -> DataFrame:
    """The best split of every node of one level, from histograms summed by member."""
    first, wide, d, trees = 2 ** level - 1, 2 ** level, len(grown.features), grown.trees

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(members), d, wide * width * 2))
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                codes, y = grown.codes(_columns(part, grown.features)), _columns(part, [label])[:, 0].astype(np.int64)
                w, h = _columns(part, weights), part.column("_h").to_numpy().view(np.uint64)
                cell = codes * 2 + y
                for fit in np.unique(members // trees).tolist():
                    drawn = np.flatnonzero(w[:, fit] > 0)
                    if not len(drawn):
                        continue
                    mine, row_h, row_w = np.flatnonzero(members // trees == fit), h[drawn], w[drawn, fit]
                    for m in mine.tolist():
                        rows, weight = drawn, row_w
                        if trees > 1:
                            times = _times(row_h, seed, int(members[m]) % trees)
                            taken = np.flatnonzero(times)
                            rows, weight = rows.take(taken), weight.take(taken) * times.take(taken)
                        node = grown.descend(codes, int(members[m]), rows, level) - first
                        if level and node.min(initial=0) < 0:
                            still = np.flatnonzero(node >= 0)
                            rows, weight, node = rows.take(still), weight.take(still), node.take(still)
                        node *= 2 * width
                        for f in range(d):
                            total[m, f] += np.bincount(node + cell[f].take(rows), weight, wide * width * 2)
        yield pa.RecordBatch.from_arrays([pa.array(members), pa.array([t.tobytes() for t in total], pa.binary())], ["member", "cells"])

    names = ["node", "feature", "cut", "gain", "rows", "positive", "left", "left_positive"]

    def choose(table: pa.Table) -> pa.Table:
        member = table["member"][0].as_py()
        hist = sum(np.frombuffer(c.as_py()) for c in table["cells"]).reshape(d, wide, width, 2).transpose(1, 0, 2, 3)
        left = hist.cumsum(2)
        whole = left[:, :, -1:, :]
        out = []
        with np.errstate(divide="ignore", invalid="ignore"):
            pure = lambda s: 1 - ((s / s.sum(-1, keepdims=True)) ** 2).sum(-1)
            n, nl = whole.sum(-1), left.sum(-1)
            gain = pure(whole) - nl / n * pure(left) - (n - nl) / n * pure(whole - left)
        gain = np.where((nl >= 1) & (n - nl >= 1), gain, -1.0)
        for node in np.flatnonzero(n[:, 0, 0] > 0):
            mine = gain[node].copy()
            if tried < d:
                order = np.argsort(_mix(np.arange(d, dtype=np.uint64) + np.uint64(((seed * 7919 + member % trees) * 4096 + first + int(node)) * 64 & 0xFFFFFFFFFFFF)))
                mine[order[tried:]] = -1.0
            f, c = np.unravel_index(int(mine.argmax()), mine.shape)
            out.append((int(node), int(f), int(c), float(mine[f, c]), float(n[node, 0, 0]), float(whole[node, 0, 0, 1]), float(nl[node, f, c]), float(left[node, f, c, 1])))
        cols = list(zip(*out)) if out else [[] for _ in names]
        kinds = [pa.int32()] * 3 + [pa.float64()] * 5
        return pa.table([pa.array([member] * len(out), pa.int64()), *(pa.array(c, t) for c, t in zip(cols, kinds))], ["member", *names])

    parts = df.mapInArrow(count, "member long, cells binary")
    return parts.groupBy("member").applyInArrow(choose, "member long, node int, feature int, cut int, gain double, rows double, positive double, left double, left_positive double")


# ---------------------------------------------------------------- Bayes

@dataclass
class Bayes:
    features: list[str]
    prior: np.ndarray       # fits x classes, in logarithms
    first: np.ndarray       # fits x classes x features: mean, or log share
    second: np.ndarray | None   # variance
    low: np.ndarray | None      # fits x features: smallest training reading

    def score(self, df: DataFrame, which: str, name: str = "score") -> DataFrame:
        def score(batch: pa.RecordBatch) -> np.ndarray:
            x, fit = _columns(batch, self.features), _columns(batch, [which])[:, 0].astype(np.int64)
            if self.second is None:
                log = self.prior[fit] + (self.first[fit] * np.maximum(x - self.low[fit], 0)[:, None, :]).sum(2)
            else:
                gap = x[:, None, :] - self.first[fit]
                log = self.prior[fit] - (np.log(2 * np.pi * self.second[fit]) / 2 + gap * gap / (2 * self.second[fit])).sum(2)
            return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -700, 700)))

        return _scored(df, name, [*self.features, which], score)


def fit_bayes(df: DataFrame, features: list[str], label: str, weights: list[str], kind: str = "gaussian", smoothing: float = 1.0) -> Bayes:
    """Naive Bayes of two classes for all weight columns, from sums by class. ``multinomial`` shifts readings by each fit's training minimum."""
    k, d = len(weights), len(features)
    low = None
    if kind == "multinomial":
        row = df.agg(*[F.min(F.when(F.col(w) > 0, F.col(f).cast("double"))).alias(f"{w}_{f}") for w in weights for f in features]).first()
        low = np.array([[row[f"{w}_{f}"] if row[f"{w}_{f}"] is not None else 0.0 for f in features] for w in weights])

    def of(batch: pa.RecordBatch) -> np.ndarray:
        x, y, w = _columns(batch, features), _columns(batch, [label])[:, 0], _columns(batch, weights)
        out = np.zeros((k, 2, 1 + 2 * d))
        for c in (0, 1):
            v = w * (y == c)[:, None]
            out[:, c, 0] = v.sum(0)
            if low is None:
                out[:, c, 1:d + 1], out[:, c, d + 1:] = v.T @ x, v.T @ (x * x)
            else:
                for m in range(k):
                    out[m, c, 1:d + 1] = v[:, m] @ np.maximum(x - low[m], 0)
        return out

    sums = _totals(df, [*features, label, *weights], (k, 2, 1 + 2 * d), of)
    n, s = sums[:, :, 0], sums[:, :, 1:d + 1]
    if kind == "multinomial":
        prior = np.log(n + smoothing) - np.log(n.sum(1, keepdims=True) + 2 * smoothing)
        return Bayes(features, prior, np.log(s + smoothing) - np.log(s.sum(2, keepdims=True) + smoothing * d), None, low)
    with np.errstate(divide="ignore"):
        prior = np.log(n / np.maximum(n.sum(1, keepdims=True), 1))
    mean = s / np.maximum(n[:, :, None], 1)
    return Bayes(features, prior, mean, np.maximum(sums[:, :, d + 1:] / np.maximum(n[:, :, None], 1) - mean * mean, 1e-12), None)


# ---------------------------------------------------------------- low-rank basis

@dataclass
class Basis:
    features: list[str]
    mean: np.ndarray
    spread: np.ndarray
    axes: np.ndarray        # features x components, orthonormal
    variance: np.ndarray    # along each axis, of standardised readings
    total: float

    def error(self, df: DataFrame, name: str = "error") -> DataFrame:
        """Mean squared gap between a row's standardised readings and their projection."""
        def score(batch: pa.RecordBatch) -> np.ndarray:
            z = (_columns(batch, self.features) - self.mean) / self.spread
            return ((z - z @ self.axes @ self.axes.T) ** 2).mean(1)

        return _scored(df, name, self.features, score)


def fit_basis(df: DataFrame, features: list[str], components: int, oversample: int = 8, rounds: int = 4, seed: int = 42) -> Basis:
    """Principal axes of standardised readings, by randomised subspace iteration.

    A round is one pass that sums the Gram product with a thin block, features x (components + oversample), so a table of many
    columns never needs the full Gram matrix. Tables with no more columns than the block is wide come out exact in one round.
    """
    d = len(features)
    width = min(d, components + oversample)
    one = df.select(*[F.col(f).cast("double").alias(f) for f in features], F.lit(1.0).alias("_w"))
    n, mean, spread = (x[0] for x in _moments(one, features, ["_w"]))

    def product(q: np.ndarray) -> np.ndarray:
        def of(batch: pa.RecordBatch) -> np.ndarray:
            z = (_columns(batch, features) - mean) / spread
            return z.T @ (z @ q)

        return _totals(one, features, (d, q.shape[1]), of) / max(1.0, n - 1)

    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, width)))[0]
    for _ in range(0 if width == d else rounds):
        q = np.linalg.qr(product(q))[0]
    value, turn = np.linalg.eigh(q.T @ product(q))
    best = np.argsort(value)[::-1][:components]
    axes = q @ turn[:, best]
    axes *= np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    varied = _totals(one, features, (d,), lambda batch: (((_columns(batch, features) - mean) / spread) ** 2).sum(0)) / max(1.0, n - 1)
    return Basis(features, mean, spread, axes, value[best], float(varied.sum()))


#: Models that can be fitted for many weight columns at once: (fit, settings it takes under which names).
AT_ONCE = {
    "logistic_regression": (lambda df, x, y, i, w, **s: fit_linear(df, x, y, w, "logistic", **s), {"regParam": "ridge", "maxIter": "steps"}),
    "svm": (lambda df, x, y, i, w, **s: fit_linear(df, x, y, w, "squared_hinge", **{"ridge": 0.1, **s}), {"regParam": "ridge", "maxIter": "steps"}),
    "decision_tree": (lambda df, x, y, i, w, **s: fit_trees(df, x, y, i, w, 1, **s), {"maxDepth": "depth", "maxBins": "bins", "seed": "seed"}),
    "random_forest": (lambda df, x, y, i, w, **s: fit_trees(df, x, y, i, w, **{"trees": 2000, **s}),
                      {"numTrees": "trees", "maxDepth": "depth", "maxBins": "bins", "seed": "seed"}),
    "naive_bayes": (lambda df, x, y, i, w, **s: fit_bayes(df, x, y, w, "multinomial", **s), {"smoothing": "smoothing"}),
    "gaussian_naive_bayes": (lambda df, x, y, i, w, **s: fit_bayes(df, x, y, w, "gaussian", **s), {}),
}


def fit_at_once(model: str, df: DataFrame, features: list[str], label: str, row_id: str, weights: list[str], **settings) -> Linear | Trees | Bayes:
    fit, known = AT_ONCE[model]
    return fit(df, features, label, row_id, weights, **{known[s]: v for s, v in settings.items()})
