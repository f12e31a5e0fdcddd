"""Where jobs may write, and how finely they cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session.

    Where none is named, a fresh local one on a local master, and one beside the warehouse on a cluster, whose
    executors would not see the driver's disk.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
            named = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        else:
            named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_runs"
        spark.sparkContext.setCheckpointDir(named)
    return named


def run_dir(spark: SparkSession, name: str) -> str:
    """A folder of its own for one run of one job."""
    return f"{shared_dir(spark).rstrip('/')}/tidewatch/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage, survives lost executors.

    For tables that several later jobs read, such as training folds and
    oversampled rows; later filters and column choices reach the files.
    """
    path = run_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def default_buckets(spark: SparkSession) -> int:
    """How many range buckets ordered operators cut their input into."""
    return max(8, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def hash_bits(spark: SparkSession) -> int:
    """How many leading hash bits make a range bucket: about four buckets per shuffle partition."""
    return min(30, max(5, (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()))
