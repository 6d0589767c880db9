"""Remote snapshots: JSON exports over HTTP as DataFrames."""

from __future__ import annotations

import json
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession

_ELEMENT = "id string, name string, stereotype string, c4_level string, language string, file_path string, container string"
_EDGE = "source_id string, target_id string, rel_type string"


def fetch(url: str, timeout: float = 30, body: dict | None = None) -> dict:
    """The JSON document at a URL (POST if there is a body)."""
    data = None if body is None else json.dumps(body).encode()
    with urlopen(Request(url, data, {"Content-Type": "application/json"}), timeout=timeout) as answer:  # noqa: S310
        return json.load(answer)


def as_tables(spark: SparkSession, document: dict) -> tuple[DataFrame, DataFrame]:
    """Elements and relationships of an exported snapshot."""
    pick = lambda rows, schema: [tuple(r.get(f.split()[0]) for f in schema.split(", ")) for r in rows]
    return spark.createDataFrame(pick(document.get("elements", []), _ELEMENT), _ELEMENT), spark.createDataFrame(pick(document.get("relationships", []), _EDGE), _EDGE)


def remote_snapshot(spark: SparkSession, base: str, timeout: float = 30) -> tuple[DataFrame, DataFrame]:
    return as_tables(spark, fetch(f"{base.rstrip('/')}/export", timeout))
