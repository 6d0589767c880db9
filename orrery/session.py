"""Session settings and worker imports."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.ui.enabled": "false",
}


def session(master: str = "local[8]", **extra: str) -> SparkSession:
    """A session with the settings the operators are tested with."""
    builder = SparkSession.builder.master(master).config(map=CONF | {k.replace("__", "."): v for k, v in extra.items()})
    return builder.getOrCreate()


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers started from here on find this package (where the cluster shares the path)."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([*paths, ROOT])
    return spark
