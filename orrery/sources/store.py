"""The snapshot store: Parquet tables partitioned by snapshot, and JSON exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = ("snapshots", "elements", "relationships", "change_history")


def save(root: str, snapshot_id: str, **tables: DataFrame) -> str:
    """Write the tables of one snapshot; its earlier rows are replaced, other snapshots stay."""
    for name, df in tables.items():
        if name not in TABLES:
            raise ValueError(f"unknown table {name}")
        rows = df.withColumn("snapshot_id", F.lit(snapshot_id))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(f"{root}/{name}")
    return snapshot_id


def read(spark: SparkSession, root: str, name: str, snapshot_id: str | None = None) -> DataFrame:
    """A table of the store; with a snapshot only its partition is read."""
    df = spark.read.parquet(f"{root}/{name}")
    return df if snapshot_id is None else df.where(F.col("snapshot_id") == snapshot_id)


def latest_first(snapshots: DataFrame, n: int) -> DataFrame:
    return snapshots.orderBy(F.desc("ts"), F.desc("snapshot_id")).limit(n)


def with_previous(snapshots: DataFrame) -> DataFrame:
    return snapshots.withColumn("previous", F.lag("snapshot_id").over(Window.orderBy("ts")))  # a row for each snapshot only


def find(snapshots: DataFrame, ref: str) -> DataFrame:
    """The snapshot of this id, else the latest one of this commit."""
    return snapshots.where((F.col("snapshot_id") == ref) | (F.col("commit_sha") == ref)).orderBy(F.when(F.col("snapshot_id") == ref, 0).otherwise(1), F.desc("ts")).limit(1)


def append_history(root: str, changes: DataFrame) -> None:
    """Add rows of a difference to the change history."""
    changes.write.mode("append").parquet(f"{root}/change_history")


def export_json(elements: DataFrame, relationships: DataFrame, path: str) -> None:
    """Both tables as JSON lines below path."""
    elements.write.mode("overwrite").json(f"{path}/elements")
    relationships.write.mode("overwrite").json(f"{path}/relationships")


def load_export(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Elements and relationships of an export: one JSON document with both lists, or a folder of :func:`export_json`."""
    if path.endswith(".json"):
        doc = spark.read.json(path, multiLine=True)
        return doc.select(F.explode("elements").alias("e")).select("e.*"), doc.select(F.explode("relationships").alias("r")).select("r.*")
    return spark.read.json(f"{path}/elements"), spark.read.json(f"{path}/relationships")


def is_fresh(heads: DataFrame, commit: str | None) -> bool:
    """Whether the latest snapshot is of this commit; without a commit or a snapshot it isn't."""
    rows = latest_first(heads, 1).select("commit_sha").collect()
    return bool(commit and rows and rows[0][0] == commit)
