"""Graph queries over the lens of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from ..sources import lens
from .registry import query

L = "WITH RECURSIVE " + lens.SQL
_RISK = "CASE WHEN stereotype IN ('Controller', 'Gateway', 'Configuration') THEN 'HIGH' WHEN stereotype IN ('Repository', 'Service', 'Middleware', 'Worker', 'UI Component') THEN 'MEDIUM' ELSE 'LOW' END"
_LAYER = "CASE WHEN stereotype IN ('Controller', 'Gateway', 'UI Component') THEN 1 WHEN stereotype = 'Middleware' THEN 2 WHEN stereotype IN ('Repository', 'Entity', 'Shared Data') THEN 4 WHEN stereotype = 'Configuration' THEN 5 ELSE 3 END"


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


_IMPACT = f"""{L},
g AS (SELECT source_id, target_id, max(rel_type) AS rel_type FROM rels GROUP BY ALL),
w(id, hops) AS (SELECT 'region:0', 0 UNION SELECT g.source_id, hops + 1 FROM w JOIN g ON g.target_id = w.id WHERE hops < 3),
levels AS (SELECT id, min(hops) AS hops FROM w GROUP BY id),
parents AS (
  SELECT g.source_id AS id, a.hops, arg_min(g.target_id, g.target_id) AS parent, arg_min(g.rel_type, g.target_id) AS rel
  FROM g JOIN levels a ON a.id = g.source_id JOIN levels b ON b.id = g.target_id AND b.hops = a.hops - 1 WHERE a.hops > 0 GROUP BY ALL),
c(id, hops, reason) AS (
  SELECT p.id, 1, p.rel || ' → ' || e.name FROM parents p JOIN elements e ON e.id = p.parent WHERE p.hops = 1
  UNION ALL SELECT p.id, p.hops, e.name || ' →(' || p.rel || ') ' || c.reason FROM parents p JOIN c ON c.id = p.parent JOIN elements e ON e.id = p.parent WHERE p.hops = c.hops + 1),
hit AS (SELECT id, name, stereotype, file_path, hops, reason, {_RISK} AS risk FROM c JOIN elements USING (id))
"""


def _impact(spark, d):
    return graph.impact(lens.elements(spark, d), lens.relationships(spark, d), ids(spark, "region:0"), 3)


@query("G2_impact", _IMPACT + "SELECT * FROM hit")
def impact(spark, d):
    return _impact(spark, d)


@query(
    "G4_impact_summary",
    _IMPACT + "SELECT count(*) FILTER (hops = 1) AS direct, count(*) FILTER (hops > 1) AS transitive, count(*) AS total, count(*) FILTER (risk = 'HIGH') AS high_risk, "
    "round(coalesce(sum(CASE WHEN stereotype IN ('Controller', 'Gateway') THEN 3.0::DOUBLE WHEN stereotype IN ('Service', 'Worker', 'Middleware') THEN 2.0 WHEN stereotype IN ('Repository', 'UI Component') THEN 1.5 WHEN stereotype = 'Configuration' THEN 2.5 ELSE 1.0 END), 0), 1) AS risk_score FROM hit",
)
def impact_summary(spark, d):
    return graph.impact_summary(_impact(spark, d))


@query(
    "G5_suggestions",
    _IMPACT + """, near AS (
  SELECT string_agg(s, ', ' ORDER BY s) AS near FROM (SELECT DISTINCT name || ' (' || stereotype || ')' AS s FROM hit WHERE hops = 1 ORDER BY s LIMIT 6)),
high AS (SELECT coalesce(string_agg(name, ', ' ORDER BY name), '') AS high FROM (SELECT DISTINCT name FROM hit WHERE hops = 1 AND risk = 'HIGH' ORDER BY name LIMIT 6)),
s AS (SELECT id, name, near, high FROM elements, near, high WHERE id = 'region:0')
SELECT id, 1 AS ord, 'Revise the dependants of ' || name || ': ' || near AS text FROM s WHERE near IS NOT NULL
UNION ALL SELECT id, 2, 'Test the entry points over ' || name || ': ' || high FROM s WHERE high <> ''
UNION ALL SELECT id, 3, 'Check migrations and mappings of ' || name FROM s""",
)
def suggestions(spark, d):
    e = lens.elements(spark, d)
    return graph.suggestions(graph.impact(e, lens.relationships(spark, d), ids(spark, "region:0"), 1), e.where("id = 'region:0'"))


@query("G1_simple_graph", f"{L} SELECT source_id, target_id, max(rel_type) AS rel_type FROM rels GROUP BY ALL")
def simple(spark, d):
    return graph.simple_graph(lens.relationships(spark, d))


@query("G3_risk", f"{L} SELECT stereotype, {_RISK} AS risk, count(*) AS n FROM elements GROUP BY ALL")
def risk(spark, d):
    from ..schema import risk as label

    return lens.elements(spark, d).groupBy("stereotype", label("stereotype").alias("risk")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "G6_dependency_walk",
    f"""{L}, s AS (SELECT source_id AS a, target_id AS b FROM rels UNION ALL SELECT target_id, source_id FROM rels),
w(id, hops) AS (SELECT 'supplier:3', 0 UNION SELECT b, hops + 1 FROM w JOIN s ON a = id WHERE hops < 2) SELECT id, min(hops) AS hops FROM w GROUP BY id""",
)
def dependency_walk(spark, d):
    return graph.walk(lens.relationships(spark, d), ids(spark, "supplier:3"), "both", 2)


@query(
    "J6_one_hop",
    f"""{L}, hit AS (SELECT id FROM elements WHERE lower(name) = 'nation:7' OR contains(lower(id), 'nation:7')),
f AS (SELECT DISTINCT 'upstream' AS direction, rel_type, source_id AS id FROM rels WHERE target_id IN (FROM hit)
  UNION SELECT 'downstream', rel_type, target_id FROM rels WHERE source_id IN (FROM hit))
SELECT direction, rel_type, id, name FROM f LEFT JOIN elements USING (id)""",
)
def one_hop(spark, d):
    return graph.dependencies(lens.elements(spark, d), lens.relationships(spark, d), "nation:7")


@query(
    "G7_shortest_path",
    f"""{L}, g AS (SELECT DISTINCT source_id, target_id FROM rels),
w(id, path) AS (SELECT 'orders:1', ['orders:1'] UNION ALL SELECT target_id, list_append(path, target_id) FROM w JOIN g ON source_id = id WHERE len(path) <= 6 AND NOT list_contains(path, target_id) AND id NOT LIKE 'region%'),
best AS (SELECT path FROM w WHERE id LIKE 'region:%' ORDER BY len(path), path LIMIT 1)
SELECT len(path)::INT - 1 AS hops, array_to_string(path, ' -> ') AS path,
  (SELECT string_agg(name, ' -> ' ORDER BY k) FROM (SELECT unnest(path) AS id, generate_subscripts(path, 1) AS k FROM best) JOIN elements USING (id)) AS names FROM best""",
)
def shortest_path(spark, d):
    e = lens.elements(spark, d)
    return graph.shortest_path(e, lens.relationships(spark, d), ids(spark, "orders:1"), e.where("id LIKE 'region:%'").select("id"))


@query(
    "G8_cycles",
    f"""{L}, g AS (SELECT DISTINCT source_id AS a, target_id AS b FROM rels WHERE source_id <> target_id),
core AS (SELECT * FROM g WHERE a IN (SELECT b FROM g) AND b IN (SELECT a FROM g))
SELECT x.a || ' -> ' || x.b AS cycle, 2 AS length FROM core x JOIN core y ON x.b = y.a AND x.a = y.b WHERE x.a < x.b
UNION ALL SELECT x.a || ' -> ' || x.b || ' -> ' || y.b, 3 FROM core x JOIN core y ON x.b = y.a JOIN core z ON y.b = z.a AND z.b = x.a WHERE x.a < x.b AND x.a < y.b
UNION ALL SELECT x.a || ' -> ' || x.b || ' -> ' || y.b || ' -> ' || z.b, 4 FROM core x JOIN core y ON x.b = y.a JOIN core z ON y.b = z.a JOIN core u ON z.b = u.a AND u.b = x.a
WHERE x.a < x.b AND x.a < y.b AND x.a < z.b AND x.b <> z.b""",
)
def cycles(spark, d):
    return graph.cycles(lens.relationships(spark, d))


_BAD = f"""{L}, k AS (SELECT id, name, {_LAYER} AS r FROM elements),
bad AS (SELECT source_id, target_id, a.name AS source, b.name AS target, rel_type, a.r::DOUBLE AS source_rank, b.r::DOUBLE AS target_rank FROM rels JOIN k a ON a.id = source_id JOIN k b ON b.id = target_id WHERE a.r > b.r)"""


@query("G9_layer_violations", f"{_BAD} SELECT * FROM bad")
def layer_violations(spark, d):
    v = graph.layer_violations(lens.elements(spark, d), lens.relationships(spark, d))
    return v.withColumn("source_rank", F.col("source_rank").cast("double")).withColumn("target_rank", F.col("target_rank").cast("double"))


@query(
    "G10_coupling",
    f"""{L}, g AS (SELECT DISTINCT source_id, target_id FROM rels),
d AS (SELECT id, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out FROM (SELECT source_id AS id, 0 AS i, 1 AS o FROM g UNION ALL SELECT target_id, 1, 0 FROM g) GROUP BY id)
SELECT *, fan_in + fan_out AS degree FROM d WHERE fan_in + fan_out >= 3""",
)
def coupling(spark, d):
    return graph.coupling(lens.relationships(spark, d))


@query("O3_most_coupled", f"""{L}, g AS (SELECT DISTINCT source_id, target_id FROM rels),
d AS (SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM g UNION ALL SELECT target_id FROM g) GROUP BY id)
SELECT id, degree FROM d WHERE degree >= 3 ORDER BY degree DESC, id LIMIT 15""")  # fmt: skip
def most_coupled(spark, d):
    return graph.coupling(lens.relationships(spark, d)).select("id", "degree").orderBy(F.desc("degree"), "id").limit(15)


@query("G11_density", f"{L}, n AS (SELECT count(*) AS nodes FROM elements), m AS (SELECT count(*) AS links FROM (SELECT DISTINCT source_id, target_id FROM rels)) SELECT nodes, links, links::DOUBLE / (nodes * (nodes - 1)) AS density FROM n, m")
def density(spark, d):
    return graph.density(lens.elements(spark, d), lens.relationships(spark, d))


_SCORE = "greatest(0, 100.0 - least(40.0, 8.0 * cycle_count) - least(30.0, 3.0 * violation_count) - least(20.0, 100.0 * links / (nodes * (nodes - 1))))::DOUBLE"
_GRADE = "CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END"


@query(
    "G12_health",
    f"""{_BAD}, g AS (SELECT DISTINCT source_id AS a, target_id AS b FROM rels),
m AS (SELECT (SELECT count(*) FROM elements) AS nodes, (SELECT count(*) FROM g) AS links, least(20, (SELECT count(*) FROM g x JOIN g y ON x.b = y.a AND x.a = y.b WHERE x.a < x.b)) AS cycle_count, (SELECT count(*) FROM bad) AS violation_count),
s AS (SELECT *, round(links::DOUBLE / (nodes * (nodes - 1)), 8) AS density, round({_SCORE}, 1) AS score FROM m) SELECT *, {_GRADE} AS grade FROM s""",
)
def health(spark, d):
    return graph.health(lens.elements(spark, d), lens.relationships(spark, d))


_YEARS = range(1995, 2002)


@query(
    "G13_health_trend",
    f"""{_BAD.replace("k AS (SELECT id, name", "k AS (SELECT id, name, since")}, y AS (SELECT unnest(range(1995, 2002))::INT AS snapshot),
n AS (SELECT snapshot, count(*) AS nodes FROM elements, y WHERE since IS NULL OR since <= snapshot GROUP BY 1),
e AS (SELECT DISTINCT snapshot, source_id, target_id, rel_type FROM rels, y WHERE since IS NULL OR since <= snapshot),
g AS (SELECT DISTINCT snapshot, source_id AS a, target_id AS b FROM e),
m AS (SELECT snapshot, nodes, (SELECT count(*) FROM g WHERE g.snapshot = n.snapshot) AS links,
  least(20, (SELECT count(*) FROM g p JOIN g q ON p.snapshot = q.snapshot AND p.b = q.a AND p.a = q.b WHERE p.a < p.b AND p.snapshot = n.snapshot)) AS cycle_count,
  (SELECT count(*) FROM e JOIN k i ON i.id = e.source_id JOIN k j ON j.id = e.target_id WHERE i.r > j.r AND e.snapshot = n.snapshot) AS violation_count FROM n),
s AS (SELECT *, round({_SCORE}, 1) AS score FROM m) SELECT *, {_GRADE} AS grade FROM s""",
)
def health_trend(spark, d):
    return graph.health_since(lens.elements(spark, d), lens.relationships(spark, d, dated=True), _YEARS[0], _YEARS[-1])


_TRACE = f"""{L}, e AS (SELECT source_id, target_id, stereotype IN ('Entity', 'Repository', 'Shared Data') AS data, stereotype = 'Repository' AS open FROM rels JOIN elements ON id = target_id),
w(entry_id, id, path, data, open) AS (
  SELECT id, id, [id], false, true FROM elements WHERE stereotype IN ('Controller', 'Gateway', 'Batch Job', 'UI Component')
  UNION ALL SELECT entry_id, target_id, list_append(path, target_id), e.data, e.open OR NOT e.data FROM w JOIN e ON e.source_id = w.id
  WHERE w.open AND len(path) <= 6 AND NOT list_contains(path, target_id)),
found AS (SELECT DISTINCT entry_id, array_to_string(path, ' -> ') AS path, len(path)::INT - 1 AS hops, CASE WHEN stereotype = 'Batch Job' THEN 'batch' ELSE 'request' END AS kind FROM w JOIN elements x ON x.id = entry_id WHERE w.data)"""


def _compat(sql: str) -> str:
    return sql.replace("stereotype = 'Repository' AS open", "false AS open")


@query("G14_traces_compat", _compat(_TRACE) + " SELECT * FROM found ORDER BY entry_id, path LIMIT 200")
def traces_compat(spark, d):
    return graph.traces(lens.elements(spark, d), lens.relationships(spark, d), through_repositories=False)


@query("G14_traces")
def traces(spark, d):
    return graph.traces(lens.elements(spark, d), lens.relationships(spark, d), max_traces=None)


@query("G15_A9_trace_kinds", _compat(_TRACE) + " SELECT kind, count(*) AS n FROM found GROUP BY 1")
def trace_kinds(spark, d):
    return graph.traces(lens.elements(spark, d), lens.relationships(spark, d), max_traces=None, through_repositories=False).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "G16_unreachable",
    f"""{L}, w(id) AS (SELECT id FROM elements WHERE stereotype IN ('Controller', 'Gateway', 'Batch Job', 'UI Component', 'Worker') UNION SELECT target_id FROM w JOIN rels ON source_id = id)
SELECT id, name, stereotype FROM elements WHERE stereotype NOT IN ('Entity', 'Shared Data', 'Configuration') AND id NOT IN (FROM w)""".replace("JOIN rels ON", "JOIN (FROM rels WHERE rel_type <> 'injects') ON"),
)
def unreachable(spark, d):
    return graph.unreachable(lens.elements(spark, d), lens.relationships(spark, d).where("rel_type <> 'injects'"))


_DEG = f"{L}, d AS (SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM rels UNION ALL SELECT target_id FROM rels) GROUP BY id)"


@query("G17_O4_hotspots", f"{_DEG} SELECT id, name, stereotype, degree FROM d JOIN elements USING (id) WHERE degree >= 2 ORDER BY degree DESC, ord LIMIT 12")
def hotspots(spark, d):
    return graph.hotspots(lens.elements(spark, d), lens.relationships(spark, d))


@query("G17_isolated", f"{_DEG.replace('FROM rels', 'FROM (FROM rels WHERE rel_type <> $$injects$$)')} SELECT id, name, stereotype FROM elements WHERE id NOT IN (SELECT id FROM d) AND stereotype NOT IN ('Controller', 'Gateway', 'Batch Job', 'UI Component', 'Worker')")
def isolated(spark, d):
    return graph.isolated(lens.elements(spark, d), lens.relationships(spark, d).where("rel_type <> 'injects'"))


@query(
    "G18_strangler",
    f"""{L}, w(id, hops) AS (SELECT 'orders:1', 0 UNION SELECT target_id, hops + 1 FROM w JOIN rels ON source_id = id WHERE hops < 8), s AS (SELECT id, min(hops) AS hops FROM w GROUP BY id)
SELECT id, name, hops, CASE WHEN stereotype = 'Entity' THEN 'table' WHEN stereotype = 'Batch Job' THEN 'job' ELSE 'program' END AS part, file_path FROM s JOIN elements USING (id) ORDER BY hops, id LIMIT 80""",
)
def strangler(spark, d):
    return graph.strangler(lens.elements(spark, d), lens.relationships(spark, d), ids(spark, "orders:1"))


@query(
    "G19_related_tables",
    f"""{L}, t AS (SELECT id, coalesce(table_name, name) AS t FROM elements WHERE stereotype = 'Entity' OR language IN ('db2', 'dataset')),
one AS (SELECT id AS entry_id, target_id AS node, 1 AS hop FROM elements JOIN rels ON source_id = id WHERE id LIKE 'orders:%'),
h1 AS (SELECT DISTINCT entry_id, t, 1 AS hop FROM one JOIN t ON t.id = node), n1 AS (SELECT entry_id, count(*) AS n FROM h1 GROUP BY 1),
two AS (SELECT DISTINCT entry_id, target_id AS node FROM one JOIN rels ON source_id = node LEFT JOIN n1 USING (entry_id) WHERE coalesce(n, 0) < 8),
v2 AS (SELECT * FROM two EXCEPT SELECT entry_id, node FROM one),
three AS (SELECT DISTINCT entry_id, target_id AS node FROM v2 JOIN rels ON source_id = node), v3 AS (SELECT * FROM three EXCEPT SELECT entry_id, node FROM one EXCEPT SELECT * FROM v2),
h3 AS (SELECT DISTINCT entry_id, t, 3 AS hop FROM v3 JOIN t ON t.id = node), n3 AS (SELECT entry_id, count(DISTINCT t) AS n FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h3) GROUP BY 1),
four AS (SELECT DISTINCT entry_id, target_id AS node FROM v3 JOIN rels ON source_id = node LEFT JOIN n3 USING (entry_id) WHERE coalesce(n, 0) < 8), v4 AS (SELECT * FROM four EXCEPT SELECT entry_id, node FROM one EXCEPT SELECT * FROM v2 EXCEPT SELECT * FROM v3),
h4 AS (SELECT DISTINCT entry_id, t, 4 AS hop FROM v4 JOIN t ON t.id = node),
best AS (SELECT entry_id, t, min(hop) AS hop FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h3 UNION ALL SELECT * FROM h4) GROUP BY 1, 2)
SELECT entry_id, string_agg(t, ',' ORDER BY hop, t) AS tables, count(*) AS n_tables FROM best GROUP BY 1""",
)
def related_tables(spark, d):
    e = lens.elements(spark, d)
    return graph.related_tables(e, lens.relationships(spark, d), e.where(F.col("id").startswith("orders:")))


@query(
    "G20_reading_path",
    f"""{L}, w(id, hops) AS (SELECT 'orders:1', 0 UNION SELECT target_id, hops + 1 FROM w JOIN rels ON source_id = id WHERE hops < 5), s AS (SELECT id, min(hops) AS hops FROM w GROUP BY id),
r AS (SELECT *, row_number() OVER (ORDER BY hops, CASE stereotype WHEN 'Worker' THEN 1 WHEN 'Service' THEN 2 WHEN 'Repository' THEN 4 WHEN 'Entity' THEN 5 ELSE 0 END, id)::INT AS step FROM s JOIN elements USING (id))
SELECT step, id, name, stereotype, file_path, hops FROM r WHERE step <= 12""",
)
def reading_path(spark, d):
    return graph.reading_path(lens.elements(spark, d), lens.relationships(spark, d), ids(spark, "orders:1"))


@query("J1_valid_edges", f"{L} SELECT DISTINCT source_id, target_id, rel_type FROM rels WHERE source_id <> target_id AND source_id IN (SELECT id FROM elements) AND target_id IN (SELECT id FROM elements)")
def valid_edges(spark, d):
    return graph.valid_edges(lens.relationships(spark, d), lens.elements(spark, d))


@query(
    "G5_surroundings",
    "SELECT 'nation:3' AS id, 6 AS ord, 'Tell the containers beyond ' || n_name || ': ' || (SELECT string_agg(x, ', ' ORDER BY x) FROM (SELECT lower(c_mktsegment) || ' (' || count(*) || ')' AS x FROM customer WHERE c_nationkey = 3 GROUP BY c_mktsegment ORDER BY x LIMIT 6)) AS text FROM nation WHERE n_nationkey = 3",
)
def around(spark, d):
    e, r = lens.elements(spark, d), lens.relationships(spark, d)
    hit = graph.impact(e, r, ids(spark, "nation:3"), 1)
    return graph.surroundings(hit, e.where("id = 'nation:3'"), e)
