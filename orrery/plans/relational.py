"""Queries of filters, counts, resolution and differences over the lens."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import relational as R
from ..schema import WEIGHT, lookup
from ..sources import lens
from .registry import query

L = "WITH RECURSIVE " + lens.SQL
_CITE = "file_path || '#' || name AS citation"
E, R_ = lens.elements, lens.relationships


@query("P1_stereotype_filter", f"{L} SELECT name, stereotype, language, file_path, id, {_CITE} FROM elements WHERE lower(stereotype) = 'gateway'")
def p1(s, d):
    return R.of_stereotype(E(s, d), "GATEWAY")


@query("P2_P5_all_elements", f"{L} SELECT name, stereotype, language, file_path, id, {_CITE} FROM elements")
def p5(s, d):
    return R.listed(E(s, d))


@query("P3_citations", f"{L} SELECT string_agg(file_path || '#' || name, ';' ORDER BY ord) AS citations FROM (SELECT * FROM elements WHERE stereotype = 'Service' ORDER BY ord LIMIT 40)")
def p3(s, d):
    return R.citations(E(s, d).where("stereotype = 'Service'"))


@query("P4_element_match", f"{L} SELECT id, name FROM elements WHERE lower(name) = 'customer#000000012' OR contains(lower(id), 'customer#000000012') OR lower(name) = 'supplier:1' OR contains(lower(id), 'supplier:1')")
def p4(s, d):
    e = E(s, d)
    return R.named(e, "Customer#000000012").unionByName(R.named(e, "supplier:1")).select("id", "name")


@query(
    "P6_changed_files",
    f"""{L} SELECT id FROM elements WHERE ends_with(file_path, 'geo/Nation3Repository.java') OR ends_with('geo/Nation3Repository.java', file_path) OR contains('geo/Nation3Repository.java', file_path)
OR ends_with(file_path, 'schema/parts/small/part_7.ddl') OR contains('schema/parts/small/part_7.ddl', file_path) OR lower(name) IN ('africa', 'orders:5') OR lower(id) IN ('africa', 'orders:5')""",
)
def p6(s, d):
    return R.changed(E(s, d), ["geo\\Nation3Repository.java", "schema/parts/small/part_7.ddl"], ["AFRICA", "orders:5"]).select("id")


@query("P7_listing", f"{L} SELECT id, name, stereotype, language FROM elements WHERE language = 'java' AND regexp_full_match(name, 'Order[0-9]*7Job')")
def p7(s, d):
    return R.listing(E(s, d), "Batch Job", "JAVA", "Order*7Job")


@query("P8_P9_containers", f"{L} SELECT coalesce(container, split_part(file_path, '/', 1)) AS container, count(*) AS n FROM elements GROUP BY 1")
def p9(s, d):
    return R.counted(R.with_container(E(s, d)), "container")


@query("P11_suppressed", f"{L} SELECT id FROM elements WHERE regexp_matches(lower(coalesce(table_name, '')), '^small.*$|^.* ring$')")
def p11(s, d):
    return E(s, d).where(N.matches_any(F.lower(F.coalesce("table_name", F.lit(""))), ["small*", "* ring"])).select("id")


@query("P13_entry_points", f"{L} SELECT id, stereotype FROM elements WHERE stereotype IN ('Controller', 'Gateway', 'UI Component', 'Batch Job', 'Worker')")
def p13(s, d):
    from ..schema import ENTRY

    return E(s, d).where(F.col("stereotype").isin(ENTRY)).select("id", "stereotype")


@query("S2_exclude", f"{L} SELECT id FROM elements WHERE NOT (list_contains(string_split(file_path, '/'), 'parts') OR regexp_matches(file_path, '/Customer[0-9]*Service\\.java$'))")
def s2(s, d):
    return E(s, d).where(~N.excluded(F.col("file_path"), ["parts", "Customer*Service.java"])).select("id")


@query("S3_S4_languages", f"{L} SELECT CASE WHEN file_path LIKE '%.java' THEN 'java' WHEN file_path LIKE '%.py' THEN 'python' END AS language, count(*) AS n FROM elements GROUP BY 1")
def s3(s, d):
    return R.counted(E(s, d), N.language_of(F.col("file_path")).alias("language"))


@query("A1_by_stereotype", f"{L} SELECT stereotype, count(*) AS n FROM elements GROUP BY 1 ORDER BY n DESC, 1")
def a1(s, d):
    return R.counted(E(s, d), "stereotype").orderBy(F.desc("n"), "stereotype")


@query("A11_grouping_sets", f"{L} SELECT coalesce(container, split_part(file_path, '/', 1)) AS container, stereotype, count(*) AS n FROM elements GROUP BY GROUPING SETS ((1, 2), (1), (2), ())")
def a11(s, d):
    return R.container_report(E(s, d))


_MATRIX = f"""{L}, c AS (SELECT id, coalesce(container, split_part(file_path, '/', 1)) AS container FROM elements),
m AS (SELECT a.container AS from_container, b.container AS to_container, count(*) AS n FROM rels JOIN c a ON a.id = source_id JOIN c b ON b.id = target_id WHERE a.container <> b.container GROUP BY 1, 2)"""


@query("A12_J16_container_matrix", f"{_MATRIX} SELECT * FROM m")
def a12(s, d):
    return R.container_matrix(E(s, d), R_(s, d))


@query("O6_strongest_container_edges", f"{_MATRIX} SELECT * FROM m ORDER BY n DESC, from_container, to_container LIMIT 10")
def o6(s, d):
    return R.container_matrix(E(s, d), R_(s, d)).orderBy(F.desc("n"), "from_container", "to_container").limit(10)


@query("A13_most_depended_on", f"{_MATRIX} SELECT to_container AS container, sum(n)::BIGINT AS n FROM m GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1")
def a13(s, d):
    return R.container_matrix(E(s, d), R_(s, d)).groupBy(F.col("to_container").alias("container")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "container").limit(1)


@query("A14_effort", f"{L}, w AS (SELECT DISTINCT source_id AS id FROM rels WHERE target_id = 'nation:2') SELECT count(*) AS affected, 30 + sum(length(file_path))::BIGINT AS effort, CASE WHEN 30 + sum(length(file_path)) < 80 THEN 'LOW' WHEN 30 + sum(length(file_path)) < 200 THEN 'MEDIUM' ELSE 'HIGH' END AS level FROM w JOIN elements USING (id)")
def a14(s, d):
    """Lines of code aren't part of the lens: the length of the path stands for a file's size."""
    hit = R_(s, d).where("target_id = 'nation:2'").select(F.col("source_id").alias("id")).distinct().join(E(s, d).select("id", F.length("file_path").cast("long").alias("size")), "id")
    total = hit.agg(F.count(F.lit(1)).alias("affected"), (F.lit(30) + F.sum("size")).alias("effort"))
    return total.withColumn("level", F.when(F.col("effort") < 80, "LOW").when(F.col("effort") < 200, "MEDIUM").otherwise("HIGH"))


@query(
    "M8_dependency_table",
    f"""{L}, f AS (SELECT * FROM elements WHERE stereotype IN ('Repository', 'Service') ORDER BY stereotype, name, id LIMIT 30),
t AS (SELECT DISTINCT f.id, f.name, f.stereotype, e.name AS target FROM f LEFT JOIN rels ON source_id = f.id LEFT JOIN elements e ON e.id = target_id)
SELECT id, name, stereotype, coalesce(array_to_string(list_sort(list(target) FILTER (target IS NOT NULL))[1:8], ','), '') AS depends_on FROM t GROUP BY 1, 2, 3""",
)
def m8(s, d):
    return R.dependency_table(E(s, d), R_(s, d), ["Repository", "Service"])


@query("M9_entry_table", f"{L} SELECT id, name FROM elements WHERE stereotype IN ('Controller', 'Gateway') ORDER BY CASE WHEN regexp_matches(name, 'Rest|Controller') THEN 0 ELSE 1 END, name LIMIT 40")
def m9(s, d):
    e = E(s, d).where("stereotype IN ('Controller', 'Gateway')")
    return e.orderBy(F.when(F.col("name").rlike("Rest|Controller"), 0).otherwise(1), "name").limit(40).select("id", "name")


_W = "CASE WHEN stereotype IN ('Controller', 'Gateway') THEN 3.0::DOUBLE WHEN stereotype IN ('Service', 'Worker') THEN 2.0 WHEN stereotype = 'Repository' THEN 1.5 ELSE 1.0 END"


@query(
    "W1_diagram_edges",
    f"""{L}, p AS (SELECT id, {_W} AS p FROM elements)
SELECT source_id, target_id, rel_type, 2 * greatest(a.p, b.p) + least(a.p, b.p) AS score FROM rels JOIN p a ON a.id = source_id JOIN p b ON b.id = target_id ORDER BY score DESC, source_id DESC, target_id DESC, rel_type LIMIT 400""",
)
def w1(s, d):
    return R.diagram_edges(E(s, d), R_(s, d), lookup("stereotype", WEIGHT, 1.0))


# -- resolution


@query(
    "J2_resolve_names",
    f"""{L}, raw AS (SELECT source_id, CASE WHEN rel_type = 'references' THEN 'com.acme.' || e.name ELSE target_id END AS target_id, rel_type FROM rels JOIN elements e ON e.id = target_id WHERE rel_type IN ('references', 'injects')),
k AS (SELECT raw.*, s.language AS sl, t.id AS known FROM raw LEFT JOIN elements s ON s.id = source_id LEFT JOIN elements t ON t.id = target_id),
o AS (SELECT DISTINCT source_id, target_id, rel_type, sl, list_last(string_split(target_id, '.')) AS last FROM k WHERE known IS NULL),
b AS (SELECT o.source_id, o.target_id AS asked, o.rel_type, e.id AS target_id, row_number() OVER (PARTITION BY o.source_id, o.target_id, o.rel_type ORDER BY e.language IS DISTINCT FROM sl, e.ord) AS n FROM o JOIN elements e ON e.name = last)
SELECT DISTINCT source_id, target_id, rel_type, false AS resolved FROM k WHERE known IS NOT NULL UNION SELECT source_id, target_id, rel_type, true FROM b WHERE n = 1""",
)
def j2(s, d):
    e = E(s, d)
    r = R_(s, d).where("rel_type IN ('references', 'injects')").join(e.select(F.col("id").alias("target_id"), F.col("name").alias("n")), "target_id")
    raw = r.select("source_id", F.when(F.col("rel_type") == "references", F.concat(F.lit("com.acme."), "n")).otherwise(F.col("target_id")).alias("target_id"), "rel_type")
    return R.resolve_names(raw, e)


_ROLES = """n AS (
  SELECT id, stereotype, CASE stereotype WHEN 'Controller' THEN 'Item' || regexp_extract(id, '[0-9]+') || 'Controller' WHEN 'Service' THEN 'Item' || regexp_extract(id, '[0-9]+') || 'Service' ELSE 'Item' || regexp_extract(id, '[0-9]+') || 'Repository' END AS name
  FROM elements WHERE stereotype IN ('Controller', 'Service', 'Repository'))"""


@query(
    "J3_naming_convention",
    f"""{L}, {_ROLES}, b AS (SELECT *, lower(regexp_replace(name, 'Controller|Service|Repository', '', 'g')) AS base FROM n)
SELECT DISTINCT x.id AS source_id, y.id AS target_id, 'injects' AS rel_type, 'naming convention' AS technology FROM b x JOIN b y USING (base)
WHERE (x.stereotype = 'Controller' AND y.stereotype = 'Service') OR (x.stereotype = 'Service' AND y.stereotype = 'Repository')""",
)
def j3(s, d):
    e = E(s, d).where("stereotype IN ('Controller', 'Service', 'Repository')").withColumn("name", F.concat(F.lit("Item"), F.regexp_extract("id", "[0-9]+", 0), "stereotype"))
    return R.naming_edges(e)


@query(
    "J4_interface_injection",
    f"""{L}, r AS (SELECT source_id, target_id, CASE WHEN rel_type = 'accesses_table' THEN 'implements' ELSE rel_type END AS rel_type FROM rels WHERE rel_type <> 'references'),
e AS (SELECT *, CASE WHEN stereotype = 'Worker' THEN [replace(name, 'Supplier', 'Customer')] ELSE []::VARCHAR[] END AS implements FROM elements),
i AS (SELECT source_id, target_id AS f FROM r WHERE rel_type = 'injects'), m AS (SELECT source_id AS target_id, target_id AS f FROM r WHERE rel_type = 'implements'),
x AS (SELECT i.source_id, c.id AS target_id FROM i JOIN e t ON t.id = f JOIN (SELECT id, unnest(implements) AS n FROM e) c ON c.n = t.name WHERE f NOT IN (SELECT f FROM m))
SELECT DISTINCT source_id, target_id, 'injects' AS rel_type FROM (SELECT i.source_id, m.target_id FROM i JOIN m USING (f) UNION ALL SELECT * FROM x) WHERE source_id <> target_id""",
)
def j4(s, d):
    e = E(s, d).withColumn("implements", F.when(F.col("stereotype") == "Worker", F.array(F.replace("name", F.lit("Supplier"), F.lit("Customer")))).otherwise(F.array().cast("array<string>")))
    r = R_(s, d).where("rel_type <> 'references'").withColumn("rel_type", F.when(F.col("rel_type") == "accesses_table", "implements").otherwise(F.col("rel_type")))
    return R.interface_edges(r, e)


@query(
    "J5_fk_linking",
    f"""{L}, x AS (SELECT id, ord, replace(coalesce(table_name, name), ' ', '_') AS t, fk_columns FROM elements WHERE stereotype = 'Entity'
  UNION ALL SELECT 'brand:' || b, 9000000000 + row_number() OVER (ORDER BY b), b, []::VARCHAR[] FROM (SELECT DISTINCT replace(p_brand, '#', '_') AS b FROM part)),
k AS (SELECT id AS source_id, unnest(fk_columns) AS fk FROM x), t AS (SELECT lower(t) AS w, arg_min(id, ord) AS target_id FROM x GROUP BY 1)
SELECT DISTINCT source_id, target_id, 'references' AS rel_type, fk FROM k JOIN t ON w = lower(regexp_replace(fk, '_ID$', '')) WHERE source_id <> target_id""",
)
def j5(s, d):
    from pyspark.sql import Window

    e = E(s, d).where("stereotype = 'Entity'").select("id", "ord", "name", "stereotype", F.replace(F.coalesce("table_name", "name"), F.lit(" "), F.lit("_")).alias("table_name"), "fk_columns")
    brand = lens.load(s, d, "part").select(F.replace("p_brand", F.lit("#"), F.lit("_")).alias("b")).distinct()
    n = F.row_number().over(Window.orderBy("b"))  # a row for each brand only
    extra = brand.select(F.concat(F.lit("brand:"), "b").alias("id"), (F.lit(9000000000) + n).alias("ord"), F.col("b").alias("name"), F.lit("Entity").alias("stereotype"), F.col("b").alias("table_name"), F.array().cast("array<string>").alias("fk_columns"))
    return R.fk_edges(e.unionByName(extra), R_(s, d))


@query(
    "E20_merge_details",
    f"""{L} SELECT id, name, coalesce(table_name, 'T' || ord) AS table_name, array_to_string(list_distinct_in_order, ',') AS columns FROM (
  SELECT id, name, ord, table_name, columns || list_filter(['X', 'REGION_ID', 'NAME'], lambda x: NOT list_contains(columns, x)) AS list_distinct_in_order FROM elements)""",
)
def e20(s, d):
    """Every element beside a poorer row of the same id, with another name, a table and more columns."""
    e = E(s, d).select("id", "name", "ord", "table_name", "columns")
    more = e.select("id", F.lit("poorer").alias("name"), (F.col("ord") + 1).alias("ord"), F.concat(F.lit("T"), "ord").alias("table_name"), F.array(F.lit("X"), F.lit("REGION_ID"), F.lit("NAME")).alias("columns"))
    both = e.withColumn("rich", F.lit(2)).unionByName(more.withColumn("rich", F.lit(1)))
    return R.merged(both, F.col("rich")).select("id", "name", "table_name", F.array_join("columns", ",").alias("columns"))


@query(
    "W4_S5_merge_by_id",
    f"""{L}, v AS (SELECT id, ord, name, length(name) AS rich FROM elements WHERE stereotype = 'Service' UNION ALL SELECT id, ord + 1, name || '+', length(name) + (ord % 3) - 1 FROM elements WHERE stereotype = 'Service')
SELECT id, name FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rich DESC, ord) AS k FROM v) WHERE k = 1""",
)
def w4(s, d):
    e = E(s, d).where("stereotype = 'Service'").select("id", "ord", "name", F.length("name").cast("long").alias("rich"))
    twice = e.unionByName(e.select("id", (F.col("ord") + 1).alias("ord"), F.concat("name", F.lit("+")).alias("name"), (F.col("rich") + F.col("ord") % 3 - 1).alias("rich")))
    return R.merged(twice, F.col("rich")).select("id", "name")


# -- differences between two years

_DIFF = f"""{L}, a AS (SELECT * FROM elements WHERE since IS NULL OR since <= 1998),
b AS (SELECT * REPLACE (CASE WHEN ord % 7 = 0 AND since IS NOT NULL THEN 'Worker' ELSE stereotype END AS stereotype, CASE WHEN ord % 13 = 0 THEN 'moved/' || file_path ELSE file_path END AS file_path)
  FROM elements WHERE (since IS NULL OR since <= 2000) AND NOT (coalesce(kind, '') = 'db2_table' AND ord % 11 = 0)),
j AS (SELECT coalesce(b.id, a.id) AS id, coalesce(b.name, a.name) AS name, coalesce(b.stereotype, a.stereotype) AS stereotype,
  CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'modified' END AS change_type,
  CASE WHEN a.id IS NULL OR b.id IS NULL THEN '' ELSE concat_ws('; ', CASE WHEN a.stereotype <> b.stereotype THEN 'stereotype ' || a.stereotype || ' => ' || b.stereotype END, CASE WHEN a.file_path <> b.file_path THEN 'moved ' || a.file_path || ' => ' || b.file_path END) END AS diff_summary
  FROM a FULL JOIN b ON a.id = b.id), x AS (SELECT * FROM j WHERE change_type <> 'modified' OR diff_summary <> '')"""


def _two(s, d):
    e = E(s, d)
    old = e.where("since IS NULL OR since <= 1998")
    new = e.where("(since IS NULL OR since <= 2000) AND NOT (coalesce(kind, '') = 'db2_table' AND ord % 11 = 0)")
    return old, new.withColumns({"stereotype": F.expr("CASE WHEN ord % 7 = 0 AND since IS NOT NULL THEN 'Worker' ELSE stereotype END"), "file_path": F.expr("CASE WHEN ord % 13 = 0 THEN 'moved/' || file_path ELSE file_path END")})


@query("U1_J11_diff", f"{_DIFF} SELECT id, name, change_type, stereotype, diff_summary FROM x")
def u1(s, d):
    return R.difference(*_two(s, d))


@query(
    "U2_edge_diff",
    f"""{L}, a AS (SELECT DISTINCT source_id, target_id, rel_type FROM rels WHERE since IS NULL OR since <= 1998), b AS (SELECT DISTINCT source_id, target_id, rel_type FROM rels WHERE (since IS NULL OR since <= 2000) AND rel_type <> 'accesses_table')
SELECT *, 'added' AS change_type FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""",
)
def u2(s, d):
    r = R_(s, d, dated=True)
    return R.edge_difference(r.where("since IS NULL OR since <= 1998"), r.where("(since IS NULL OR since <= 2000) AND rel_type <> 'accesses_table'"))


@query("A5_diff_summary", f"{_DIFF} SELECT count(*) FILTER (change_type = 'added') AS added, count(*) FILTER (change_type = 'removed') AS removed, count(*) FILTER (change_type = 'modified') AS modified, count(*) > 0 AS has_changes FROM x")
def a5(s, d):
    return R.difference_summary(R.difference(*_two(s, d)))


@query("A6_C10_headlines", f"{_DIFF}, n AS (SELECT change_type, stereotype, count(*) AS n FROM x GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY change_type ORDER BY n DESC, stereotype)::INT AS rank FROM n) SELECT * FROM r WHERE rank <= 3")
def a6(s, d):
    return R.headlines(R.difference(*_two(s, d)))


@query("U7_drift", f"{_DIFF} SELECT id, change_type FROM x WHERE change_type <> 'modified'")
def u7(s, d):
    return R.difference(*_two(s, d)).where("change_type <> 'modified'").select("id", "change_type")


_REPOS = f"""{L}, u AS (
  SELECT 'even::' || id AS id, 'even' AS source_slug, coalesce(container, 'even') AS container, CASE WHEN c4_level = 'Component' THEN 'Container' ELSE c4_level END AS c4_level FROM elements WHERE ord % 2 = 0
  UNION ALL SELECT 'odd::' || id, 'odd', coalesce(container, 'odd'), CASE WHEN c4_level = 'Component' THEN 'Container' ELSE c4_level END FROM elements WHERE ord % 2 = 1)"""


def _repos(s, d):
    e, r = E(s, d), R_(s, d)
    return R.aggregated({"even": (e.where("ord % 2 = 0"), r), "odd": (e.where("ord % 2 = 1"), r)})


@query("U3_aggregate_repos", f"{_REPOS} SELECT * FROM u")
def u3(s, d):
    return _repos(s, d)[0].select("id", "source_slug", "container", "c4_level")


@query("U3_aggregate_edges", f"{L} SELECT k || '::' || source_id AS source_id, k || '::' || target_id AS target_id, rel_type FROM rels, (SELECT unnest(['even', 'odd']) AS k)")
def u3_edges(s, d):
    return _repos(s, d)[1]


@query("A16_repo_counts", f"{_REPOS} SELECT source_slug, count(*) AS n FROM u GROUP BY 1")
def a16(s, d):
    return R.counted(_repos(s, d)[0], "source_slug")


# -- snapshots: one for each year of orders

_SNAPSHOTS = "SELECT 'snap-' || year(o_orderdate) AS snapshot_id, max(o_orderdate) AS ts, count(*) AS n_orders FROM orders GROUP BY year(o_orderdate)"


def _snapshots(s, d):
    y = F.year("o_orderdate")
    return lens.load(s, d, "orders").groupBy(y.alias("y")).agg(F.max("o_orderdate").alias("ts"), F.count(F.lit(1)).alias("n_orders")).select(F.concat(F.lit("snap-"), F.col("y").cast("string")).alias("snapshot_id"), "ts", "n_orders")


@query("S8_list_snapshots", f"SELECT * FROM ({_SNAPSHOTS}) ORDER BY ts DESC LIMIT 20")
def s8(s, d):
    from ..sources.store import latest_first

    return latest_first(_snapshots(s, d), 20)


@query("S6_latest_snapshot", f"SELECT * FROM ({_SNAPSHOTS}) ORDER BY ts DESC LIMIT 1")
def s6(s, d):
    from ..sources.store import latest_first

    return latest_first(_snapshots(s, d), 1)


@query("W6_snapshot_pairs", f"SELECT snapshot_id, lag(snapshot_id) OVER (ORDER BY ts) AS previous FROM ({_SNAPSHOTS})")
def w6(s, d):
    from ..sources.store import with_previous

    return with_previous(_snapshots(s, d)).select("snapshot_id", "previous")
