"""Session helpers: shared storage, size estimates, cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset and the master is local (tests, local runs) a folder of our own is made and set; on a
    cluster a folder of one machine would lose data, so an unset one is an error there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="loomstone-")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at files every executor can read."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bounds of the number of partitions that is derived from a size; above the most, partitions grow with the input.
MOST_PARTITIONS = 100_000


def size_in_bytes(df: DataFrame) -> int:
    """Bytes of the tables that the plan reads (file sizes for a file scan), each as often as it is read; no job runs.

    Sums over the leaves of the plan: the estimate of a join is the product of its sides, which says nothing. Where a leaf has
    no estimate the sum is 1 << 60 or more.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))


def partitions_for(df: DataFrame, target_bytes: int, least: int = 12) -> int:
    """How many partitions of about ``target_bytes`` of input the plan has, MOST_PARTITIONS at most; the session's number where
    Spark has no estimate."""
    size = size_in_bytes(df)
    if size >= 1 << 60:
        return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return min(MOST_PARTITIONS, max(least, -(-size // target_bytes)))


def spread(df: DataFrame, target_bytes: int = 1 << 20) -> DataFrame:
    """A small table that lies in fewer files than there are cores is dealt out over the cores, since a file of one row group is one
    task. What is larger than 128 MB for each core stays as it is read: it has row groups for all, and no shuffle is added."""
    cores, size = df.sparkSession.sparkContext.defaultParallelism, size_in_bytes(df)
    if size >= cores * (128 << 20) or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(max(1, min(cores, -(-size // target_bytes))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
