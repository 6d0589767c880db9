"""Intermediate results in the folder that all executors share, and partitions by the size of what is read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of input files for a partition of a large shuffle, the most partitions, and from where on a size is no size (of rows without one).
PARTITION, MOST_PARTITIONS, NO_SIZE = 16_000_000, 10_000, 1 << 62


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of our own only where that is unset and Spark runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="orrery-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed and stored in the shared folder: loops start each round from there.

    Parquet takes a fraction of the space of checkpointed rows, and its size is known: joins with few rows are broadcast.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(df: DataFrame) -> int:
    """spark.sql.shuffle.partitions; more where ``df`` reads more than that many times ``PARTITION`` bytes of files."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    wanted = sum(s for s in sizes if s < NO_SIZE) // PARTITION
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(wanted, MOST_PARTITIONS))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by keys in so many partitions that the memory of a task doesn't grow with the input."""
    return df.repartition(partitions(df), *keys)
