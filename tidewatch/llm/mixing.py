"""Temperature mixing of sources, realised as budgeted block permutations.

A source with token share s gets the weight s ** t / sum(s ** t). The exponent t is bisected (many cuts to a pass, each pass
one aggregate over the sources) until the weights' entropy, or the repetitions of the most repeated source, meet the target.
Each source is then read in passes, every pass in an order of its own, and cut at its part of the token budget; blocks take
each source's tokens in proportion to its weight and are shuffled inside. Running token counts are made by hash ranges, so
a source that holds a third of all rows is spread over a third of the ranges.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, slices, written

#: Cuts of the exponent's range in one aggregate, and passes.
CUTS, PASSES = 16, 5
#: Documents of a hash range, about.
RANGE_DOCS = 4000


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("n_tokens", pa.int64())])
    for batch in batches:
        for first, last, data, offsets in slices(batch, "text"):
            solid = ~SPACE[data]
            begins = solid.copy()
            begins[1:] &= ~solid[:-1]
            inner = offsets[:-1][offsets[:-1] < len(data)]
            begins[inner] = solid[inner]
            run = np.concatenate([[0], np.cumsum(begins)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), batch.column("source").slice(first, last - first),
                                              pa.array(run[offsets[1:]] - run[offsets[:-1]])], schema=schema)


def _bisect(value_at, low: float, high: float, target: float) -> float:
    """Exponent in [low, high] at which a falling measure first is at most ``target``; ``value_at`` takes many exponents at once."""
    for _ in range(PASSES):
        cuts = [low + (high - low) * k / CUTS for k in range(CUTS + 1)]
        values = value_at(cuts)
        k = next((k for k, v in enumerate(values) if v <= target), CUTS)
        low, high = cuts[max(0, k - 1)], cuts[k]
        if k == 0:
            return low
    return high


def temperature(sources: DataFrame, entropy: float | None = None, repetitions: float | None = None) -> float:
    """The exponent between 0 (all sources alike) and 1 (as they are) for sources (n_tokens > 0 each).

    ``entropy``: the flattest weights whose entropy, in nats, is at most this. ``repetitions``: the flattest weights under which the most
    repeated source is passed at most so many times for each pass of the least repeated one. A target that even exponent 1 doesn't
    meet gives 1; one that exponent 0 meets gives 0.
    """
    total, least, most = sources.agg(F.sum("n_tokens"), F.min("n_tokens"), F.max("n_tokens")).first()
    if not total:
        return 1.0
    if repetitions is not None:
        return _bisect(lambda cuts: [(most / least) ** (1 - t) for t in cuts], 0.0, 1.0, repetitions)
    share = F.col("n_tokens") / F.lit(float(total))

    def entropies(cuts: list[float]) -> list[float]:
        row = sources.agg(*(F.sum(F.pow(share, F.lit(t))) for t in cuts), *(F.sum(F.pow(share, F.lit(t)) * F.log(share)) for t in cuts)).first()
        return [math.log(row[k]) - t * row[len(cuts) + k] / row[k] for k, t in enumerate(cuts)]

    return _bisect(entropies, 0.0, 1.0, entropy)


def _unit(*columns: Column) -> Column:
    """A hash as a number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / F.lit(float(1 << 53))


def mix_sources(docs: DataFrame, entropy: float | None = None, repetitions: float | None = 4.0, budget: int | None = None,
                block_tokens: int = 1_000_000, seed: int = 17) -> DataFrame:
    """(doc_id, source, n_tokens, repetition, block, position): which document goes where in the mixture.

    Tokens are runs of bytes other than white space. ``budget`` is the mixture's tokens; by default so many that every source is
    passed once at least. A source gets its weight of the budget: whole passes, then the documents of one more pass that begin before
    the rest is used up. block and position order the mixture. A null source is a source of its own; a document without tokens adds
    nothing and isn't placed; repeated rows are placed like others, and null ids. Columns other than doc_id, source and text are not read.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    sized = written(named.mapInArrow(_sized, "doc_id long, source string, n_tokens long"), "sized").filter("n_tokens > 0")
    sources = written(sized.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("docs")), "sources")
    t = temperature(sources, entropy, None if entropy is not None else repetitions)
    total = sources.agg(F.sum("n_tokens")).first()[0] or 0
    share = F.col("n_tokens") / F.lit(float(max(1, total)))
    norm = sources.agg(F.sum(F.pow(share, F.lit(t)))).first()[0] or 1.0
    weighed = sources.withColumn("weight", F.pow(share, F.lit(t)) / F.lit(norm))
    if budget is None:
        budget = math.ceil(weighed.agg(F.max(F.col("n_tokens") / F.col("weight"))).first()[0] or 0)
    blocks = max(1, -(-budget // block_tokens))
    plan = weighed.select("source", F.col("n_tokens").alias("source_tokens"), F.round(F.col("weight") * budget).cast("long").alias("quota"),
                          F.greatest(F.lit(1), F.ceil(F.col("docs") / RANGE_DOCS)).cast("long").alias("ranges"))
    # Few bytes for each source; a join by value, so that null meets null. Spark broadcasts it where it knows it to be small.
    joined = sized.join(plan.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    passes = F.ceil(F.col("quota") / F.col("source_tokens")).cast("long")
    copies = joined.filter("quota > 0").withColumn("repetition", F.explode(F.sequence(F.lit(0).cast("long"), passes - 1)))
    placed = copies.withColumn("u", _unit(F.lit(seed), F.col("repetition"), F.col("doc_id"), F.col("n_tokens"))).withColumn(
        "range", F.least(F.floor(F.col("u") * F.col("ranges")), F.col("ranges") - 1))
    key = ["source", "repetition", "range"]
    inner = Window.partitionBy(*key).orderBy("u", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = placed.groupBy(*key).agg(F.sum("n_tokens").alias("in_range")).withColumn("before_range", F.sum("in_range").over(
        Window.partitionBy("source", "repetition").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("in_range"))
    offsets = offsets.select(F.col("source").alias("_source"), F.col("repetition").alias("_repetition"), F.col("range").alias("_range"), "before_range")
    begun = placed.withColumn("within", F.sum("n_tokens").over(inner) - F.col("n_tokens")).join(
        offsets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("repetition") == F.col("_repetition")) & (F.col("range") == F.col("_range")))
    begun = begun.withColumn("at", F.col("repetition") * F.col("source_tokens") + F.col("before_range") + F.col("within")).filter("at < quota")
    ordered = begun.withColumn("block", F.least(F.floor(F.col("at") * F.lit(float(blocks)) / F.col("quota")), F.lit(blocks - 1)).cast("long"))
    order = Window.partitionBy("block").orderBy(_unit(F.lit(seed + 1), F.col("block"), F.col("doc_id"), F.col("repetition")), "doc_id", "repetition", "source", "at")
    return ordered.withColumn("position", F.row_number().over(order).cast("long") - 1).select("doc_id", "source", "n_tokens", "repetition", "block", "position")
