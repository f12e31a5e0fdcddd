"""From raw documents to a training mixture: five stages, each an operator of tidewatch.llm over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import written
from tidewatch.llm.decontaminate import drop_contaminated
from tidewatch.llm.mixing import mix_sources
from tidewatch.llm.neardup import near_duplicates
from tidewatch.llm.qualityrules import keep_good
from tidewatch.llm.repeats import cut_repeats

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id; of repeated rows with that id, one."""
    kept = near_duplicates(docs, size=5, percent=80).filter("kept").select("doc_id").distinct()
    same = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return same.unionByName(docs.filter("doc_id is null")).select(*docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that occur elsewhere are cut out of the texts; a text of which nothing but white space is left goes."""
    return cut_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document goes in the mixture: every source is passed once at least, and none more than four times as often as another."""
    return mix_sources(docs)


STAGES: list[tuple[str, Stage]] = [("quality rules", quality), ("MinHash near-dedup", near_dedup), ("suffix-array dedup", repeats),
                                   ("benchmark decontamination", decontamination), ("mixing sources", mixing)]
#: No stage but the first could be said in SQL; tests/llm compares each with a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what one keeps is written for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{k}")
    return docs
