"""Seeded splits and folds that do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.portable import clip01, key_bucket, order_key, uniform
from ..shared import hash_bits, written
from .ordered import ranked


def _ranked_by_hash(df: DataFrame, by: list[str], id_col: str, seed: int) -> DataFrame:
    """Rank rows per class along a seeded hash order; the hash prefix is the range bucket."""
    keyed = df.withColumn("_key", order_key(seed, id_col)).withColumn("_bucket", key_bucket("_key", hash_bits(df.sparkSession)))
    return ranked(keyed, by, ["_key", id_col], "_rank").drop("_key", "_bucket")


def stratified_folds(df: DataFrame, label: str, id_col: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Fold number 0..k-1; every class is spread evenly, to within one row."""
    return _ranked_by_hash(df, [label], id_col, seed).withColumn(
        "fold", F.expr(f"CAST((_rank - 1) % {int(k)} AS INT)")).drop("_rank")


def rank_bands(df: DataFrame, label: str, id_col: str, seed: int, bands: dict[str, Column], rest: str,
               name: str = "band", by: list[str] = ()) -> DataFrame:
    """Cut every class (of each group) at given ranks of its seeded hash order, without ranking every row.

    ``bands`` gives, in order, the last rank of each band as an expression over
    ``_n`` (class size) and ``_least`` (size of the smallest class); what lies
    above goes to ``rest``. Per (class, hash bucket) only counts are computed.
    A bucket that falls into one band is settled straight from the scan; only
    the few buckets that a cut runs through are shuffled and ranked.
    """
    keyed = df.withColumn("_key", order_key(seed, id_col)).withColumn(
        "_bucket", key_bucket("_key", hash_bits(df.sparkSession)))

    def band_of(rank: Column) -> Column:
        out = F.lit(rest)
        for band, last in reversed(bands.items()):
            out = F.when(rank <= last, band).otherwise(out)
        return out

    mine = F.struct(*by, label)
    sizes = keyed.groupBy(mine.alias("_class"), F.col("_bucket").alias("_cut")).agg(F.count(F.lit(1)).alias("_size"))
    per_class = Window.partitionBy("_class")
    ahead = per_class.orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    per_group = Window.partitionBy(*[F.col("_class")[c] for c in by]) if by else Window.partitionBy(F.lit(0))
    cuts = sizes.withColumns({"_ahead": F.coalesce(F.sum("_size").over(ahead), F.lit(0)), "_n": F.sum("_size").over(per_class)})
    cuts = cuts.withColumn("_least", F.min("_n").over(per_group))
    first, last = band_of(F.col("_ahead") + 1), band_of(F.col("_ahead") + F.col("_size"))
    cuts = written(cuts.withColumns({"_band": first, "_settled": first == last}), "cuts")

    marked = keyed.join(cuts,
                        mine.eqNullSafe(F.col("_class")) & (F.col("_bucket") == F.col("_cut")))
    kept = [*df.columns, name]
    whole = marked.where("_settled").withColumn(name, F.col("_band")).select(*kept)
    place = F.row_number().over(Window.partitionBy("_class", "_cut").orderBy("_key", id_col))
    edge = marked.where(~F.col("_settled")).withColumn("_place", place).withColumn(
        name, band_of(F.col("_ahead") + F.col("_place"))).select(*kept)
    return whole.unionByName(edge)


def stratified_holdout(df: DataFrame, label: str, id_col: str, seed: int = 42, test: float = 0.2,
                       validation: float = 0.2) -> DataFrame:
    """Column ``split``: ``test`` share of each class, then ``validation`` share of the rest, then train."""
    n_test = F.floor(F.col("_n") * test + 0.5)
    n_val = F.floor((F.col("_n") - n_test) * validation + 0.5)
    return rank_bands(df, label, id_col, seed, {"test": n_test, "validation": n_test + n_val}, "train", "split")


def hash_split(df: DataFrame, id_col: str, share: float = 0.8, seed: int = 1234) -> DataFrame:
    """Random train/test split decided row by row; no shuffle, same rows on every run."""
    return df.withColumn("split", F.when(uniform(seed, id_col) < share, "train").otherwise("test"))


def hash_sample(df: DataFrame, id_col: str, share: float = 0.1, seed: int = 42) -> DataFrame:
    """Bernoulli sample decided row by row."""
    return df.where(uniform(seed, id_col) < share)


def shuffled(df: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """Rows in a seeded random order."""
    return df.withColumn("_key", order_key(seed, id_col)).orderBy("_key", id_col).drop("_key")


def random_baseline(df: DataFrame, id_col: str, positive_rate, seed: int) -> DataFrame:
    """Column ``baseline``: 1 with the given probability, decided row by row."""
    return df.withColumn("baseline", (uniform(seed, id_col) < clip01(positive_rate)).cast("int"))
