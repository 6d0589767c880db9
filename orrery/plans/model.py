"""Queries of the data model, domains, capabilities, intents, topics and contracts over the lens."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import model as M
from ..sources import lens
from .registry import query

L = "WITH RECURSIVE " + lens.SQL
E, R_ = lens.elements, lens.relationships

ALIASES = {"red ring": "blue ring"}
SAME = {"small parts": ["small ring", "small gear", "small bolt"]}
_CANON = "CASE WHEN lower(t) = 'red ring' THEN 'blue ring' WHEN lower(t) IN ('small ring', 'small gear', 'small bolt') THEN 'small parts' ELSE t END"
_UNION = "list_transform(list_sort(list({'o': ord, 'c': %s})), lambda x: x.c)"


def _dedupe(arrays: str) -> str:
    """Order-preserving distinct of a list of lists."""
    return f"list_transform(list_sort(list_transform(list_distinct(flatten({arrays})), lambda v: {{'p': list_position(flatten({arrays}), v), 'v': v}})), lambda x: x.v)"


_CDM = f"""{L}, x AS (SELECT ord, id, name, coalesce(table_name, name) AS t, columns, fk_columns, 2 * len(columns) + len(fk_columns) + CASE WHEN table_name IS NULL THEN 0 ELSE 50 END + CASE WHEN kind = 'db2_table' THEN 25 ELSE 0 END AS score FROM elements WHERE stereotype = 'Entity'),
y AS (SELECT *, {_CANON} AS canonical FROM x),
g AS (SELECT lower(canonical) AS key, max({{'s': score, 'o': -ord, 'c': canonical, 'n': name, 'i': id}}) AS b, {_UNION % 'columns'} AS cs, {_UNION % 'fk_columns'} AS fs,
  list_sort(list(DISTINCT t) FILTER (lower(t) <> lower(canonical))) AS al, count(*) AS members FROM y GROUP BY 1),
cdm AS (SELECT key, b.c AS canonical, b.n AS name, b.i AS best_id, {_dedupe('cs')} AS columns, {_dedupe('fs')} AS fk_columns, coalesce(al, []) AS aliases, members FROM g),
assoc AS (SELECT DISTINCT a.canonical AS source, b.canonical AS target, fk FROM (SELECT *, unnest(fk_columns) AS fk FROM cdm) a JOIN cdm b ON b.key = lower(regexp_replace(fk, '_ID$', '')) WHERE a.key <> b.key)"""


def _entities(s, d):
    return M.cdm_entities(E(s, d), ALIASES, SAME)


@query("A3_W8_cdm_entities", f"{_CDM} SELECT key, canonical, name, best_id, array_to_string(columns, ',') AS columns, array_to_string(fk_columns, ',') AS fk_columns, array_to_string(aliases, ',') AS aliases, members FROM cdm")
def a3(s, d):
    return _entities(s, d).select("key", "canonical", "name", "best_id", *(F.array_join(c, ",").alias(c) for c in ("columns", "fk_columns", "aliases")), "members")


_BRANDED = _CDM.replace("coalesce(table_name, name) AS t", "CASE WHEN id LIKE 'part:%' THEN 'Brand_' || (ord % 25) ELSE name END AS t")


def _branded(s, d):
    e = E(s, d).withColumn("table_name", F.when(F.col("id").startswith("part:"), F.concat(F.lit("Brand_"), (F.col("ord") % 25).cast("string"))).otherwise(F.col("name")))
    return M.cdm_entities(e, ALIASES, SAME)


@query("J13_cdm_associations", f"{_BRANDED} SELECT source, target, fk FROM assoc")
def j13(s, d):
    return M.cdm_associations(_branded(s, d))


@query("A4_cdm_stats", f"{_BRANDED} SELECT count(*) AS entities, sum(len(columns))::BIGINT AS columns_total, count(*) FILTER (len(aliases) > 0) AS with_aliases, sum(members)::BIGINT AS members, (SELECT count(*) FROM assoc) AS associations FROM cdm")
def a4(s, d):
    e = _branded(s, d)
    return M.cdm_stats(e, M.cdm_associations(e))


@query("A2_model_summary", f"{L} SELECT count(*) FILTER (stereotype = 'Entity') AS entities, count(*) FILTER (stereotype = 'Repository') AS repositories, count(*) FILTER (stereotype = 'Shared Data') AS shared, count(*) FILTER (stereotype = 'Entity' AND len(columns) > 0) AS with_columns, (SELECT count(*) FROM rels WHERE rel_type IN ('references', 'accesses_table')) AS data_relationships FROM elements")
def a2(s, d):
    return M.model_summary(E(s, d), R_(s, d))


@query("O1_O5_widest_tables", f"{_CDM} SELECT canonical, len(columns)::INT AS n_columns FROM cdm ORDER BY 2 DESC, lower(canonical) LIMIT 15")
def o1(s, d):
    return M.widest(_entities(s, d))


@query("O2_sample_names", f"{L} SELECT DISTINCT name FROM elements WHERE stereotype = 'Repository' ORDER BY name LIMIT 15")
def o2(s, d):
    return E(s, d).where("stereotype = 'Repository'").select("name").distinct().orderBy("name").limit(15)


@query("F8_canonical_names", f"{L}, n AS (SELECT DISTINCT name AS t FROM elements WHERE stereotype = 'Entity') SELECT t AS name, {_CANON} AS canonical FROM n")
def f8(s, d):
    return E(s, d).where("stereotype = 'Entity'").select("name").distinct().withColumn("canonical", M.canonical(F.col("name"), ALIASES, SAME))


# -- schema files made from the parts


def _ddl(s, d):
    text = F.expr("'CREATE TABLE IF NOT EXISTS shop.part_' || p_partkey || ' (\\n  part_id INTEGER,\\n  name VARCHAR(' || p_size || '),\\n  price DECIMAL(10, 2),\\n  CONSTRAINT pk PRIMARY KEY (part_id)\\n);\\n-- end'")
    return lens.load(s, d, "part").select(F.concat(F.lit("db/part_"), "p_partkey", F.lit(".sql")).alias("path"), text.alias("text"))


@query("E29_ddl_tables", "SELECT 'part_' || p_partkey AS name, 'part_id,name,price' AS columns, 'db/part_' || p_partkey || '.sql' AS source FROM part")
def e29(s, d):
    return M.ddl_tables(_ddl(s, d)).select("name", F.array_join("columns", ",").alias("columns"), "source")


@query("E29_ddl_tables_compat", "SELECT 'part_' || p_partkey AS name, 'part_id,name' AS columns, 'db/part_' || p_partkey || '.sql' AS source FROM part")
def e29c(s, d):
    return M.ddl_tables(_ddl(s, d), compat=True).select("name", F.array_join("columns", ",").alias("columns"), "source")


@query("E30_change_logs", "SELECT 'supplier_' || s_suppkey AS name, 'id,nation_' || s_nationkey AS columns FROM supplier")
def e30(s, d):
    text = F.expr("'changeSet:\\n - createTable:\\n     tableName: supplier_' || s_suppkey || '\\n     columns:\\n      - column: {name: id}\\n      - column:\\n          name: nation_' || s_nationkey")
    files = lens.load(s, d, "supplier").select(F.concat(F.lit("log"), "s_suppkey").alias("path"), text.alias("text"))
    return M.change_log_tables(files).select("name", F.array_join("columns", ",").alias("columns"))


def _schema(s, d):
    """A table for each part name; every other one misses a column."""
    parts = lens.load(s, d, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("_")).alias("n"), "p_size")
    text = F.expr("'create table ' || n || ' (\\nPART_ID int,\\nSIZE_' || p_size || ' int\\n)'")
    return M.ddl_tables(parts.where("p_partkey % 3 <> 0").select(F.format_string("db/%08d.sql", "p_partkey").alias("path"), text.alias("text")))


_SCHEMA = """s0 AS (SELECT 'db/' || lpad(p_partkey::VARCHAR, 8, '0') || '.sql' AS source, replace(p_name, ' ', '_') AS name, ['PART_ID', 'SIZE_' || p_size] AS columns, p_partkey AS ord FROM part WHERE p_partkey % 3 <> 0)"""


@query("E31_merge_tables", f"WITH {_SCHEMA}, m AS (SELECT lower(name) AS key, arg_min(name, source) AS name, {_UNION % 'columns'} AS cs, list_sort(list(DISTINCT source)) AS sources FROM s0 GROUP BY 1) SELECT key, name, array_to_string({_dedupe('cs')}, ',') AS columns, array_to_string(sources, ',') AS sources FROM m")
def e31(s, d):
    return M.merged_tables(_schema(s, d)).select("key", "name", F.array_join("columns", ",").alias("columns"), F.array_join("sources", ",").alias("sources"))


@query(
    "J12_U6_C11_schema_drift",
    f"""{_CDM.replace("coalesce(table_name, name) AS t", "replace(name, ' ', '_') AS t")}, {_SCHEMA},
sc AS (SELECT lower(name) AS key, list_distinct(flatten(list(columns))) AS columns, min(name) AS name FROM s0 GROUP BY 1),
j AS (SELECT coalesce(sc.name, cdm.canonical) AS name, CASE WHEN cdm.key IS NULL THEN 'schema_only' WHEN sc.key IS NULL THEN 'model_only' ELSE 'columns' END AS status,
  coalesce(list_sort(list_filter(list_distinct(list_transform(sc.columns, lambda v: lower(v))), lambda v: NOT list_contains(list_transform(cdm.columns, lambda w: lower(w)), v))), []) AS a,
  coalesce(list_sort(list_filter(list_distinct(list_transform(cdm.columns, lambda v: lower(v))), lambda v: NOT list_contains(list_transform(sc.columns, lambda w: lower(w)), v))), []) AS b FROM sc FULL JOIN cdm ON sc.key = cdm.key)
SELECT name, status, CASE WHEN status = 'columns' THEN array_to_string(a, ',') ELSE '' END AS not_in_model, CASE WHEN status = 'columns' THEN array_to_string(b, ',') ELSE '' END AS not_in_schema FROM j WHERE status <> 'columns' OR len(a) > 0 OR len(b) > 0""",
)
def j12(s, d):
    e = E(s, d).withColumn("table_name", F.replace("name", F.lit(" "), F.lit("_")))
    return M.schema_drift(M.merged_tables(_schema(s, d)), M.cdm_entities(e, ALIASES, SAME))


# -- domains, capabilities, intents

_TOKEN = """CASE WHEN file_path LIKE 'services/%' THEN split_part(file_path, '/', 2) WHEN language = 'java' AND regexp_matches(file_path, '/com/[^/]+/[^/]+/') THEN regexp_extract(file_path, '/com/[^/]+/([^/]+)/', 1) ELSE split_part(file_path, '/', 1) END"""


@query(
    "A7_F3_domains",
    f"""{L}, n AS (SELECT name, stereotype, table_name, coalesce(container, {_TOKEN}) AS domain, CASE WHEN container IS NULL THEN 'package' ELSE 'container' END AS signal FROM elements),
h AS (SELECT domain, stereotype, count(*) AS n FROM n GROUP BY 1, 2), hh AS (SELECT domain, string_agg(stereotype || ':' || n, ',' ORDER BY stereotype) AS stereotypes FROM h GROUP BY 1),
t AS (SELECT domain, min(signal) AS signal, count(*) AS size, array_to_string(list_sort(list(DISTINCT coalesce(table_name, name)) FILTER (stereotype = 'Entity'))[1:40], ',') AS tables FROM n GROUP BY 1)
SELECT domain AS name, signal, size, stereotypes, coalesce(tables, '') AS tables FROM t JOIN hh USING (domain) WHERE size >= 2 OR signal <> 'package'""",
)
def a7(s, d):
    return M.domains(E(s, d))


_TITLE = "CASE WHEN stereotype = 'Batch Job' THEN regexp_replace(name, 'Job$', '') || ' batch' WHEN stereotype = 'Gateway' THEN regexp_replace(name, 'Gateway$', '') || ' gateway' WHEN stereotype = 'Controller' THEN regexp_replace(name, 'Controller$', '') ELSE name END"
_CAPS = f"caps AS (SELECT trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS id, {_TITLE} AS title, name AS element, stereotype, 'proposed' AS status FROM elements WHERE stereotype IN ('Controller', 'Gateway', 'Batch Job', 'UI Component', 'Worker'))"


@query("C2_F1_F2_capabilities", f"{L}, {_CAPS} SELECT * FROM caps")
def c2(s, d):
    return M.capabilities(E(s, d))


@query(
    "U4_J14_W2_merge_capabilities",
    f"""{L}, {_CAPS}, old AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'renamed-' || s_suppkey ELSE 'supplier-' || lpad(s_suppkey::VARCHAR, 9, '0') END AS id, 'Supply ' || s_suppkey AS title,
  CASE WHEN s_suppkey % 5 = 0 THEN 'Gone' || s_suppkey ELSE s_name END AS element, CASE WHEN s_suppkey % 2 = 0 THEN 'approved' ELSE 'rejected' END AS status FROM supplier),
m AS (SELECT c.*, a.id AS i1, a.title AS t1, a.status AS s1, b.id AS i2, b.title AS t2, b.status AS s2 FROM caps c LEFT JOIN old a ON a.id = c.id LEFT JOIN (SELECT * FROM old WHERE id NOT IN (SELECT id FROM caps)) b ON a.id IS NULL AND b.element = c.element)
SELECT coalesce(i1, i2, id) AS id, coalesce(t1, t2, title) AS title, element, coalesce(s1, s2, status) AS status, false AS missing_in_code FROM m
UNION ALL SELECT id, title, element, status, true FROM old WHERE id NOT IN (SELECT i1 FROM m WHERE i1 IS NOT NULL) AND id NOT IN (SELECT i2 FROM m WHERE i2 IS NOT NULL)""",
)
def u4(s, d):
    old = lens.load(s, d, "supplier").select(
        F.expr("CASE WHEN s_suppkey % 3 = 0 THEN 'renamed-' || s_suppkey ELSE 'supplier-' || lpad(CAST(s_suppkey AS STRING), 9, '0') END AS id"), F.expr("'Supply ' || s_suppkey AS title"),
        F.expr("CASE WHEN s_suppkey % 5 = 0 THEN 'Gone' || s_suppkey ELSE s_name END AS element"), F.expr("CASE WHEN s_suppkey % 2 = 0 THEN 'approved' ELSE 'rejected' END AS status"),
    )
    return M.merged_capabilities(old, M.capabilities(E(s, d)))


@query("A10_capability_counts", f"{L}, {_CAPS} SELECT stereotype, status, count(*) AS n FROM caps GROUP BY 1, 2")
def a10(s, d):
    return M.capabilities(E(s, d)).groupBy("stereotype", "status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "C1_apply_intents",
    f"""{L} SELECT id, CASE WHEN name = 'NATION_3' THEN 'Gateway' ELSE stereotype END AS stereotype, CASE WHEN name = 'AFRICA' THEN 'geo-team' END AS owner,
  array_to_string(list_filter([CASE WHEN file_path LIKE 'schema/%' AND NOT file_path LIKE '%/small/%' THEN 'data' END, CASE WHEN file_path NOT LIKE '%.py' THEN 'core' END], lambda x: x IS NOT NULL), ',') AS domains,
  CASE WHEN name IN ('ASIA', 'NATION_3') THEN 'checkout' ELSE '' END AS critical_paths FROM elements""",
)
def c1(s, d):
    out = M.apply_intents(E(s, d), {"NATION_3": "Gateway"}, {"AFRICA": "geo-team"}, {"data": (["schema/*"], ["*/small/*"]), "core": ([], ["*.py"])}, {"checkout": ["ASIA", "NATION_3"]})
    return out.select("id", "stereotype", "owner", F.array_join("domains", ",").alias("domains"), F.array_join("critical_paths", ",").alias("critical_paths"))


_RULES = [("Repository", "service", "data knows no services"), ("WORKER", "nation_3", "not here"), ("Building", "geo", "segment")]


@query(
    "J9_P10_forbidden_edges",
    f"""{L}, r(s, t, reason) AS (VALUES ('repository', 'service', 'data knows no services'), ('worker', 'nation_3', 'not here'), ('building', 'geo', 'segment')),
g AS (SELECT DISTINCT id, lower(unnest([name, stereotype, container])) AS tag FROM elements)
SELECT DISTINCT s, t, reason, source_id, target_id, rel_type FROM r JOIN g a ON a.tag = s JOIN rels ON source_id = a.id JOIN g b ON b.id = target_id AND b.tag = t""",
)
def j9(s, d):
    return M.forbidden_edges(E(s, d), R_(s, d), s.createDataFrame(_RULES, "source string, target string, reason string"))


def _paths(s):
    return s.createDataFrame([("checkout", ["ASIA", "Nowhere", "NATION_3", "Absent"]), ("ok", ["AFRICA", "EUROPE"])], "name string, elements array<string>")


@query("J10_A15_missing_on_paths", f"{L}, p(path, name) AS (VALUES ('checkout', 'ASIA'), ('checkout', 'Nowhere'), ('checkout', 'NATION_3'), ('checkout', 'Absent'), ('ok', 'AFRICA'), ('ok', 'EUROPE')) SELECT path, string_agg(name, ',' ORDER BY name) AS missing FROM p WHERE name NOT IN (SELECT name FROM elements) GROUP BY 1")
def j10(s, d):
    return M.missing_on_paths(E(s, d), _paths(s))


@query("G21_W7_path_edges", "SELECT 'checkout' AS path, a AS source_name, b AS target_name, 'composes' AS rel_type FROM (VALUES ('ASIA', 'Nowhere'), ('Nowhere', 'NATION_3'), ('NATION_3', 'Absent')) t(a, b) UNION ALL SELECT 'ok', 'AFRICA', 'EUROPE', 'composes'")
def g21(s, d):
    return M.path_edges(_paths(s))


# -- topics and contracts

_ENDS = "ends AS (SELECT DISTINCT 'user_' || user_id || '.py' AS file_path, CASE WHEN value >= 200 THEN 'producer' ELSE 'consumer' END AS role, 'Kafka' AS technology, event_type AS topic FROM events)"


def _event_files(s, d):
    """A source file for each event: a producer for high values, else a consumer of its type."""
    text = F.expr("CASE WHEN value >= 200 THEN 'producer.send(\"' || event_type || '\", x)' ELSE 'consumer.subscribe([\"' || event_type || '\"])' END")
    return lens.load(s, d, "events").select(F.concat(F.lit("user_"), "user_id", F.lit(".py")).alias("path"), text.alias("text"))


@query("E32_endpoints", f"WITH {_ENDS} SELECT * FROM ends")
def e32(s, d):
    return M.endpoints(_event_files(s, d))


@query("A8_topics", f"WITH {_ENDS} SELECT topic, count(DISTINCT file_path) FILTER (role = 'producer') AS producers, count(DISTINCT file_path) FILTER (role = 'consumer') AS consumers, min(technology) AS technology FROM ends GROUP BY 1")
def a8(s, d):
    return M.topics(M.endpoints(_event_files(s, d)))


@query("J7_topic_edges", f"WITH {_ENDS} SELECT DISTINCT p.file_path AS source_id, c.file_path AS target_id, 'publishes_to' AS rel_type, topic FROM ends p JOIN ends c USING (topic) WHERE p.role = 'producer' AND c.role = 'consumer' AND p.file_path <> c.file_path")
def j7(s, d):
    return M.topic_edges(M.endpoints(_event_files(s, d)))


_PATH = "CASE WHEN regexp_replace(regexp_replace(regexp_replace(url, '^https?://[^/]+', ''), '\\?.*$', ''), '/+$', '') = '' THEN '/' ELSE regexp_replace(regexp_replace(regexp_replace(url, '^https?://[^/]+', ''), '\\?.*$', ''), '/+$', '') END"


@query("F4_url_paths", f"SELECT page_id, {_PATH} AS path FROM pages")
def f4(s, d):
    return lens.load(s, d, "pages").select("page_id", N.url_path(F.col("url")).alias("path"))


def _call_files(s, d):
    text = F.expr("CASE WHEN page_id % 3 = 0 THEN 'httpx.get(\"' || url || '\")' WHEN page_id % 3 = 1 THEN 'await fetch(''' || url || ''')' ELSE 'requests.post(\"' || url || '\", json=x)' END")
    return lens.load(s, d, "pages").select(F.concat(F.lit("page_"), "page_id", F.lit(".py")).alias("path"), text.alias("text"))


_CALLS = f"calls AS (SELECT 'page_' || page_id || '.py' AS file_path, CASE WHEN page_id % 3 = 2 THEN 'POST' ELSE 'GET' END AS method, url, {_PATH} AS path FROM pages)"


@query("E33_call_sites", f"WITH {_CALLS} SELECT * FROM calls")
def e33(s, d):
    return M.call_sites(_call_files(s, d))


def _specs(s):
    spec = '{"paths": {"/en/{id}": {"get": {}, "post": {}}, "/de/:id": {"get": {"x": 1}, "parameters": []}, "/fr/{id}.html": {"post": {}}}}'
    return s.createDataFrame([("shop", spec), ("broken", "{not json")], "service string, text string")


@query("S16_operations", "SELECT * FROM (VALUES ('shop', 'GET', '/en/{id}'), ('shop', 'POST', '/en/{id}'), ('shop', 'GET', '/de/:id'), ('shop', 'POST', '/fr/{id}.html')) t(service, method, path)")
def s16(s, d):
    return M.operations(_specs(s))


@query("J8_F5_contract_links", f"WITH {_CALLS}, ops(service, method, template, rx) AS (VALUES ('shop', 'GET', '/en/{{id}}', '/en/[^/]+'), ('shop', 'POST', '/en/{{id}}', '/en/[^/]+'), ('shop', 'GET', '/de/:id', '/de/[^/]+'), ('shop', 'POST', '/fr/{{id}}.html', '/fr/[^/]+\\.html')) SELECT file_path, calls.method, url, path, template, service FROM calls JOIN ops ON calls.method = ops.method AND regexp_full_match(path, rx)")
def j8(s, d):
    return M.contract_links(M.call_sites(_call_files(s, d)), M.operations(_specs(s)))


@query("A11_M7_container_names", f"{L}, e AS (SELECT coalesce(container, split_part(file_path, '/', 1)) AS container, stereotype, name FROM elements) SELECT container, stereotype, count(*) AS n, array_to_string(list_sort(list(DISTINCT name))[1:12], ',') AS names FROM e GROUP BY 1, 2")
def names_by_container(s, d):
    return M.report_rows(E(s, d))


_NUMBERED = "row_number() OVER (ORDER BY (status <> 'approved')::INT, missing_in_code::INT, lower(title), id)::INT AS k"
_OLD = """old AS (SELECT 'c-' || s_suppkey AS id, 'Supply ' || s_suppkey AS title, s_name AS element, CASE WHEN s_suppkey % 3 = 0 THEN 'approved' ELSE 'proposed' END AS status, s_suppkey % 5 = 0 AS missing_in_code FROM supplier)"""


def _old(s, d):
    return lens.load(s, d, "supplier").selectExpr("'c-' || s_suppkey AS id", "'Supply ' || s_suppkey AS title", "s_name AS element", "CASE WHEN s_suppkey % 3 = 0 THEN 'approved' ELSE 'proposed' END AS status", "s_suppkey % 5 = 0 AS missing_in_code")


@query("W3_playbook_order", f"WITH {_OLD} SELECT id, {_NUMBERED} FROM old QUALIFY k <= 7")
def w3(s, d):
    return M.in_playbook_order(_old(s, d), 7).select("id", "k")


@query("M5_matching_capabilities", f"WITH {_OLD} SELECT id, CASE WHEN id = 'supply 1' THEN 0 WHEN lower(title) LIKE '%supply 1%' THEN 1 ELSE 2 END AS rank FROM old WHERE id = 'supply 1' OR lower(title) LIKE '%supply 1%' OR lower(element) = 'supply 1'")
def m5(s, d):
    return M.matching_capabilities(_old(s, d), " Supply 1").select("id", "rank")


@query("C14_match_capability", f"WITH {_OLD} SELECT id, title FROM old WHERE lower(title) LIKE '%supply 1%' ORDER BY (status <> 'approved')::INT, missing_in_code::INT, lower(title), id LIMIT 1")
def c14(s, d):
    return M.match_capability(_old(s, d), "supply 1").select("id", "title")


@query(
    "C3_synced_capabilities",
    f"""{L}, {_CAPS} SELECT id, CASE WHEN id = 'supplier-000000001' THEN 'Kept' ELSE title END AS title, CASE WHEN id = 'supplier-000000001' THEN 'approved' ELSE status END AS status, false AS missing_in_code FROM caps
UNION ALL SELECT 'gone', 'Gone', 'approved', true""",
)
def c3(s, d):
    old = s.createDataFrame([("supplier-000000001", "Kept", "Supplier#000000001", "approved"), ("gone", "Gone", "Nobody", "approved")], "id string, title string, element string, status string")
    return M.synced(old, E(s, d)).select("id", "title", "status", "missing_in_code")


@query("C2_capability_tables", "SELECT s_name AS element, 'services/supply/worker_' || s_suppkey || '.py' AS file_path, r_name AS related_tables FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey")
def c2_tables(s, d):
    """Workers' own walks: without the edges back to customers, a supplier leads to its nation's region."""
    workers = E(s, d).where("stereotype <> 'Batch Job' AND stereotype NOT IN ('Controller', 'Gateway')")
    edges = R_(s, d).where("rel_type IN ('injects', 'accesses_table') AND source_id NOT LIKE 'orders%'")
    return M.with_tables(M.capabilities(workers), workers, edges).select("element", "file_path", "related_tables")


@query("A7_unassigned", "SELECT 'x:' || s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 10 = 0 THEN 'only' || s_suppkey END AS domain FROM supplier WHERE s_suppkey % 5 = 0 ORDER BY name, id LIMIT 100")
def a7_unassigned(s, d):
    """A tenth of the elements have a package of their own, a tenth none, the others one in common."""
    path = F.expr("CASE WHEN s_suppkey % 10 = 0 THEN 'packages/only' || s_suppkey || '/a.py' WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'packages/all/a.py' END")
    e = lens.load(s, d, "supplier").select(F.expr("'x:' || s_suppkey").alias("id"), F.col("s_name").alias("name"), path.alias("file_path"), F.lit("python").alias("language"), F.lit(None).cast("string").alias("container"))
    return M.unassigned(e)


@query("C12_cdm_from_exports", f"{L} SELECT lower(n) AS key, 2 * count(*) AS members FROM (SELECT coalesce(table_name, name) AS n FROM elements WHERE stereotype = 'Entity') GROUP BY 1")
def c12(s, d):
    e, r = E(s, d), R_(s, d)
    return M.from_exports({"one": (e, r), "two": (e, r)})[0].select("key", "members")


@query("U5_merged_events", "SELECT 'a' AS source_slug, e_type AS event, count(*) AS n FROM (SELECT event_type AS e_type FROM events) GROUP BY 2 UNION ALL SELECT 'b', event_type, count(*) FROM events GROUP BY 2")
def u5(s, d):
    events = lens.load(s, d, "events").select(F.col("event_type").alias("event"))
    return M.merged_events({"a": events, "b": events}).groupBy("source_slug", "event").agg(F.count(F.lit(1)).alias("n"))


@query("P14_freshness", f"SELECT 'c' || year(max(o_orderdate)) AS commit_sha, true AS fresh FROM orders")
def p14(s, d):
    from ..sources.store import is_fresh

    heads = lens.load(s, d, "orders").select(F.year("o_orderdate").alias("y"), F.col("o_orderdate").alias("ts")).groupBy("y").agg(F.max("ts").alias("ts")).selectExpr("'snap-' || y AS snapshot_id", "'c' || y AS commit_sha", "ts")
    years = [r[0] for r in heads.select("commit_sha").collect()]
    return s.createDataFrame([(c, is_fresh(heads, c)) for c in years], "commit_sha string, fresh boolean").where("fresh")
