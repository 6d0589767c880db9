"""The driver's relational tables seen as an architecture: elements and relationships (each depends on its target)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PLAIN = "'Component' AS c4_level"

#: By table: expressions of ord, id, name, stereotype, language, file_path, container, kind, table_name, columns, fk_columns.
_ELEMENTS = {
    "region": [
        "CAST(r_regionkey AS BIGINT)", "'region:' || r_regionkey", "r_name", "'Entity'", "'db2'", "'schema/geo/region_' || r_regionkey || '.ddl'", "'geo'", "'db2_table'", "r_name",
        "ARR('REGION_ID', 'NAME')", "NONE",
    ],
    "nation": [
        "CAST(1000000000 + n_nationkey AS BIGINT)", "'nation:' || n_nationkey", "n_name", "'Repository'", "'java'", "'src/main/java/com/acme/geo/Nation' || n_nationkey || 'Repository.java'", "'geo'", "NULLTEXT", "NULLTEXT",
        "ARR('NATION_ID', 'NAME', 'REGION_ID')", "ARR('REGION_ID')",
    ],
    "customer": [
        "2000000000 + c_custkey", "'customer:' || c_custkey", "c_name", "'Service'", "'java'", "'src/main/java/com/acme/' || lower(c_mktsegment) || '/Customer' || c_custkey || 'Service.java'", "lower(c_mktsegment)", "NULLTEXT", "NULLTEXT",
        "NONE", "NONE",
    ],
    "supplier": [
        "3000000000 + s_suppkey", "'supplier:' || s_suppkey", "s_name", "'Worker'", "'python'", "'services/supply/worker_' || s_suppkey || '.py'", "NULLTEXT", "NULLTEXT", "NULLTEXT",
        "NONE", "NONE",
    ],
    "part": [
        "4000000000 + p_partkey", "'part:' || p_partkey", "p_name", "'Entity'", "'db2'", "'schema/parts/' || lower(p_type) || '/part_' || p_partkey || '.ddl'", "NULLTEXT", "'db2_table'", "p_name",
        "ARR('PART_ID', replace(p_brand, '#', '_') || '_ID', 'SIZE_' || p_size)", "ARR(replace(p_brand, '#', '_') || '_ID')",
    ],
    "orders": [
        "5000000000 + o_orderkey", "'orders:' || o_orderkey",
        "'Order' || o_orderkey || CASE o_orderstatus WHEN 'O' THEN 'Controller' WHEN 'P' THEN 'Gateway' ELSE 'Job' END",
        "CASE o_orderstatus WHEN 'O' THEN 'Controller' WHEN 'P' THEN 'Gateway' ELSE 'Batch Job' END", "'java'",
        "'src/main/java/com/acme/' || lower(replace(substr(o_orderpriority, 3), ' ', '')) || '/Order' || o_orderkey || '.java'", "NULLTEXT", "NULLTEXT", "NULLTEXT",
        "NONE", "NONE",
    ],
}
_NAMES = ["ord", "id", "name", "stereotype", "language", "file_path", "container", "kind", "table_name", "columns", "fk_columns"]
_YEAR = {"orders": "year(o_orderdate)"}


def _exprs(table: str, array: str, none: str) -> list[str]:
    made = [f"{e.replace('ARR(', array + '(').replace('NONE', none).replace('NULLTEXT', 'CAST(NULL AS VARCHAR)' if array != 'array' else 'CAST(NULL AS STRING)')} AS {n}" for e, n in zip(_ELEMENTS[table], _NAMES, strict=True)]
    return [*made, f"CAST({_YEAR.get(table, 'NULL')} AS INT) AS since", _PLAIN]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, id, name, stereotype, language, file_path, container, kind, table_name, columns, fk_columns, since, c4_level."""
    parts = [load(spark, sf_dir, t).selectExpr(*_exprs(t, "array", "CAST(array() AS ARRAY<STRING>)")) for t in _ELEMENTS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def relationships(spark: SparkSession, sf_dir: str, dated: bool = False) -> DataFrame:
    """source_id, target_id, rel_type; with ``dated`` also since, the year of the order that the edge belongs to."""
    read = lambda t: load(spark, sf_dir, t)
    none = [F.lit(None).cast("int").alias("since")] if dated else []

    def edge(df: DataFrame, source: str, target: str, rel: str, *more) -> DataFrame:
        return df.select(F.expr(source).alias("source_id"), F.expr(target).alias("target_id"), F.lit(rel).alias("rel_type"), *(more or none))

    year = [F.year("o_orderdate").alias("since")] if dated else []
    line = read("lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    if dated:
        line = line.join(read("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    capital = read("customer").groupBy("c_nationkey").agg(F.min("c_custkey").alias("c"))
    parts = [
        edge(read("nation"), "'nation:' || n_nationkey", "'region:' || n_regionkey", "accesses_table"),
        edge(read("customer"), "'customer:' || c_custkey", "'nation:' || c_nationkey", "injects"),
        edge(read("supplier"), "'supplier:' || s_suppkey", "'nation:' || s_nationkey", "injects"),
        edge(read("orders"), "'orders:' || o_orderkey", "'customer:' || o_custkey", "injects", *year),
        # Lines repeat keys: distinct keys are found on the narrow numbers, before ids are built.
        edge(line.drop("l_suppkey").distinct(), "'orders:' || l_orderkey", "'part:' || l_partkey", "references", *year),
        edge(line.drop("l_partkey").distinct(), "'orders:' || l_orderkey", "'supplier:' || l_suppkey", "calls", *year),
        edge(capital, "'nation:' || c_nationkey", "'customer:' || c", "calls"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _sql(dated: bool) -> str:
    union = "\n  UNION ALL ".join(f"SELECT {', '.join(_exprs(t, 'list_value', '[]::VARCHAR[]'))} FROM {t}" for t in _ELEMENTS)
    return f"""elements AS (
  {union}),
rels AS (
  SELECT 'nation:' || n_nationkey AS source_id, 'region:' || n_regionkey AS target_id, 'accesses_table' AS rel_type, NULL::INT AS since FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'injects', NULL FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'injects', NULL FROM supplier
  UNION ALL SELECT 'orders:' || o_orderkey, 'customer:' || o_custkey, 'injects', year(o_orderdate) FROM orders
  UNION ALL SELECT DISTINCT 'orders:' || l_orderkey, 'part:' || l_partkey, 'references', year(o_orderdate) FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT DISTINCT 'orders:' || l_orderkey, 'supplier:' || l_suppkey, 'calls', year(o_orderdate) FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || min(c_custkey), 'calls', NULL FROM customer GROUP BY c_nationkey)"""


#: The same two tables as common table expressions (elements, rels) for DuckDB.
SQL = _sql(dated=True)
