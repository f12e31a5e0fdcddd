"""Quality rules with risk-controlled thresholds.

Each rule is a feature that is high in poor text and a cutoff above which a text is rejected. For every stratum and rule,
cutoffs are tried from the highest down on labelled texts. A cutoff is certified if an exact binomial test rejects that it
turns away more than ``risk / rules`` of the good texts: P(Binomial(n, risk / rules) <= wrongly rejected) must not exceed
``confidence_error / ((strata + 1) x rules)``. Trying stops at the first failure (a fixed sequence needs no further correction), and
the Bonferroni share covers strata and rules, so with probability 1 - confidence_error no stratum loses more than ``risk`` of
its good texts. Among certified cutoffs the one with the best balance of poor and good texts rejected is taken.

A stratum with too few good texts for that, whatever they say, tries one cutoff for all rules together instead, against the whole
``risk``: a sequence of nested rejections that needs no share by rule and so a tenth of the labels. Strata too small even for
this are pooled, and the bound holds for the pool. Where nothing can be certified nothing is rejected. Copies of one text count
as one label.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, lookup, mix, prefix_hash, range_hash, slices, words, written

WINDOW = 5
#: Rules, each a share that is high in poor text.
RULES = ("symbols_per_word", "repeated_line_share", "repeated_word_share", "upper_share", "mark_share", "letters_per_word")
#: Cutoffs that are tried, as parts of 1; letters_per_word is divided by 40 first.
GRID = tuple(round(x, 4) for x in np.concatenate([np.linspace(0.01, 0.2, 20), np.linspace(0.22, 1.0, 40), np.linspace(1.1, 4.0, 30)]).tolist())

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "!?~^=_{}[]@/\\"]] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")


def _again(row: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether the (row, hash) pair occurs twice or more, whether it occurred before), by position."""
    key = mix(hashes + row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    twice, before = np.empty(len(key), bool), np.empty(len(key), bool)
    twice[order], before[order] = same[1:] | same[:-1], same[:-1]
    return twice, before


def text_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of each text of a slice, rows x COUNTS."""
    rows = len(offsets) - 1
    out = np.zeros((rows, len(COUNTS)), np.int64)
    if not len(data):
        return out

    def total(flags: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(flags)])
        return run[offsets[1:]] - run[offsets[:-1]]

    prefix = prefix_hash(data)
    start, end, row = words(data, offsets)
    solid = ~SPACE[data]
    out[:, 0] = np.bincount(row, minlength=rows)
    out[:, 1] = total(solid & ((data & 0xC0) != 0x80))
    out[:, 2], out[:, 6], out[:, 7] = total(_SYMBOL[data]), total(_UPPER[data]), total(_MARK[data])
    # Lines end at \n and at the text's end.
    breaks = np.flatnonzero(data == 10)
    first = np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1])
    first = np.unique(first[first < len(data)])
    own = np.searchsorted(offsets, first, "right") - 1
    stop = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, first)], offsets[own + 1])
    run = np.concatenate([[0], np.cumsum(solid)])
    has = run[stop] > run[first]
    first, stop, own = first[has], stop[has], own[has]
    out[:, 5] = np.bincount(own, minlength=rows)
    out[:, 3] = np.bincount(own[_again(own, range_hash(prefix, first, stop))[1]], minlength=rows)
    if len(start) >= WINDOW:
        hashes = range_hash(prefix, start, end)
        n = len(start) - WINDOW + 1
        acc = np.zeros(n, np.uint64)
        for k in range(WINDOW):
            acc = acc * np.uint64(0x9FB21C651E98DF25) + hashes[k:n + k]
        inside = np.flatnonzero(row[:n] == row[WINDOW - 1:])
        found = inside[_again(row[inside], acc[inside])[0]]
        edge = np.zeros(len(start) + 1, np.int64)
        np.add.at(edge, found, 1)
        np.add.at(edge, found + WINDOW, -1)
        out[:, 4] = np.bincount(row[np.cumsum(edge)[:-1] > 0], minlength=rows)
    return out


def rule_values(counts: np.ndarray) -> np.ndarray:
    """Feature of each rule, rows x RULES."""
    n, chars, symbols, dup, repeat, lines, upper, marks = counts.T.astype(float)
    n, chars, lines = np.maximum(n, 1), np.maximum(chars, 1), np.maximum(lines, 1)
    return np.stack([symbols / n, dup / lines, repeat / n, upper / chars, marks / chars, chars / n / 40], 1)


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("stratum", pa.string()), ("digest", pa.string()), *((c, pa.int64()) for c in COUNTS), ("base_failed", pa.bool_()),
                        ("rules", pa.list_(pa.float64()))])
    for batch in batches:
        for first, last, data, offsets in slices(batch, "text"):
            counts = text_counts(data, offsets)
            values = rule_values(counts)
            rules = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, len(RULES), dtype=np.int32)), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), batch.column("stratum").slice(first, last - first),
                                              batch.column("digest").slice(first, last - first), *(pa.array(c) for c in counts.T), pa.array(base_failed(counts)), rules], schema=schema)


MEASURED = "doc_id long, stratum string, digest string, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, rules array<double>"


def _source(docs: DataFrame, stratum: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"),
                       F.md5(F.col("text").cast("string")).alias("digest"), F.col("text").cast("string").alias("text"))


def measure(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Counts and rule features of each row's whole text; a null text has no words, a null stratum is the empty one."""
    return _source(docs, stratum).mapInArrow(_measured, MEASURED)


def binomial_below(n: int, p: float, k: int) -> float:
    """P(Binomial(n, p) <= k), summed exactly in logarithms."""
    if k >= n:
        return 1.0
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(log)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in log))


def choose_cutoff(good: np.ndarray, bad: np.ndarray, risk: float, level: float, cost: float) -> float | None:
    """The cutoff of one stratum and rule from counts by grid cell (cell g holds features in (GRID[g - 1], GRID[g]])."""
    n = int(good.sum())
    over_good, over_bad = np.cumsum(good[::-1])[::-1], np.cumsum(bad[::-1])[::-1]
    best, chosen = 0.0, None
    for g in range(len(GRID) - 1, -1, -1):
        wrong = int(over_good[g + 1])
        if wrong > n * risk or binomial_below(n, risk, wrong) > level:
            break
        gain = float(over_bad[g + 1]) - cost * wrong
        if gain > best:
            best, chosen = gain, GRID[g]
    return chosen


def least_labels(risk: float, level: float) -> int:
    """Good texts without which no cutoff can be certified."""
    return math.ceil(math.log(level) / math.log1p(-risk))


def choose_cutoffs(good: np.ndarray, bad: np.ndarray, strata: int, risk: float, confidence_error: float, cost: float) -> list[float]:
    """Cutoff of each rule of one stratum (infinite: off) from counts by rule and grid cell; the last rule is the largest feature of all."""
    rules, share = len(RULES), confidence_error / (strata + 1)
    if good[0].sum() >= least_labels(risk / rules, share / rules):
        found = [choose_cutoff(good[r], bad[r], risk / rules, share / rules, cost) for r in range(rules)]
    else:
        found = [choose_cutoff(good[rules], bad[rules], risk, share, cost)] * rules
    return [math.inf if c is None else c for c in found]


def fit_thresholds(measured: DataFrame, labels: DataFrame, risk: float = 0.05, confidence_error: float = 0.05, cost: float = 30.0) -> DataFrame:
    """(stratum, cutoffs, n): one cutoff for each rule (infinite: the rule is off there), and the rows of the stratum.

    ``labels`` has doc_id and quality (1 good, 0 poor; null counts as no label). Labels are counted by stratum, rule and grid cell
    over distinct texts that the base rules pass; the cutoffs of a stratum are chosen from these counts, of fixed size, by a task.
    """
    strata = written(measured.groupBy("stratum").agg(F.count("*").alias("n")), "strata")
    number = strata.count()
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("quality is not null").distinct()
    labelled = measured.filter("not base_failed").select("doc_id", "stratum", "digest", "rules").join(given, "doc_id").groupBy(
        "stratum", "digest", "quality").agg(F.first("rules").alias("rules"))
    values = labelled.select("stratum", "quality", F.posexplode(F.concat("rules", F.array(F.array_max("rules")))).alias("rule", "value"))
    counts = written(values.withColumn("cell", F.size(F.filter(F.array(*map(F.lit, GRID)), lambda g: g < F.col("value")))).groupBy("stratum", "rule", "cell").agg(
        F.sum((F.col("quality") == 1).cast("long")).alias("good"), F.sum((F.col("quality") == 0).cast("long")).alias("bad")), "label-counts")
    # Strata that can't certify anything by themselves go together.
    alone = least_labels(risk, confidence_error / (number + 1))
    enough = counts.filter(F.col("rule") == len(RULES)).groupBy("stratum").agg(F.sum("good").alias("g")).filter(F.col("g") >= alone).select(
        "stratum", F.col("stratum").alias("pool"))
    pools = strata.join(enough, "stratum", "left")

    def chosen(table: pd.DataFrame) -> pd.DataFrame:
        good, bad = (np.zeros((len(RULES) + 1, len(GRID) + 1), np.int64) for _ in range(2))
        at = table["rule"].to_numpy(), table["cell"].to_numpy()
        good[at], bad[at] = table["good"], table["bad"]
        return pd.DataFrame({"pool": table["pool"].iloc[:1], "cutoffs": [choose_cutoffs(good, bad, number, risk, confidence_error, cost)]})

    by_pool = counts.join(pools.select("stratum", "pool"), "stratum").groupBy("pool", "rule", "cell").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    cutoffs = by_pool.groupBy("pool").applyInPandas(chosen, "pool string, cutoffs array<double>")
    off = F.array(*[F.lit(math.inf)] * len(RULES))
    met = pools.join(cutoffs.withColumnRenamed("pool", "_pool"), F.col("pool").eqNullSafe(F.col("_pool")), "left")
    return written(met.select("stratum", F.coalesce("cutoffs", off).alias("cutoffs"), "n"), "cutoffs")


def verdict(measured: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Adds ``kept``: the base rules pass it and no rule of its stratum is above its cutoff."""
    fine = F.forall(F.zip_with("rules", "cutoffs", lambda v, c: v <= c), lambda x: x)
    held = lookup(measured, thresholds, ["stratum"], "n")
    return held.withColumn("kept", ~F.col("base_failed") & fine).drop("cutoffs", "n")


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **settings) -> DataFrame:
    """Counts, base verdict and verdict of each row: doc_id, stratum, COUNTS, base_failed, rules, kept.

    An empty or null text has no words and fails the base rules; repeated rows and null ids are rows like others (a null id has
    no label). Columns other than doc_id, text and the stratum's are not read.
    """
    measured = written(measure(docs, stratum), "quality")
    return verdict(measured, fit_thresholds(measured, labels, **settings)).drop("digest")


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **settings) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    thresholds = fit_thresholds(written(measure(docs, stratum), "quality"), labels, **settings)
    named = docs.withColumn("_stratum", F.coalesce(F.col(stratum).cast("string"), F.lit("")))
    columns = docs.columns
    held = lookup(named, thresholds.select(F.col("stratum").alias("_stratum"), F.col("cutoffs").alias("_cutoffs"), F.col("n").alias("_rows")), ["_stratum"], "_rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            cutoffs = batch.column("_cutoffs").flatten().to_numpy().reshape(-1, len(RULES))
            for first, last, data, offsets in slices(batch, "text"):
                counts = text_counts(data, offsets)
                keep[first:last] = ~base_failed(counts) & (rule_values(counts) <= cutoffs[first:last]).all(1)
            yield batch.select(columns).filter(pa.array(keep))

    return held.select(*columns, "_cutoffs").mapInArrow(run, docs.schema)
