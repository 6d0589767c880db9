"""Questions in words over the lens."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import query as Q
from ..sources import lens
from .registry import query

L = "WITH RECURSIVE " + lens.SQL
_LISTED = "name, stereotype, language, file_path, id, file_path || '#' || name AS citation"


def _ask(question):
    return lambda s, d: Q.ask(lens.elements(s, d), lens.relationships(s, d), question)


query("Q2_list_repositories", f"{L} SELECT {_LISTED} FROM elements WHERE stereotype = 'Repository'")(_ask("List all repositories"))
query("Q2_how_many_workers", f"{L} SELECT {_LISTED} FROM elements WHERE stereotype = 'Worker'")(_ask("how many workers are there?"))
query("Q2_overview", f"{L} SELECT stereotype, count(*) AS n FROM elements GROUP BY 1")(_ask("Give me an overview"))
query("Q2_where_is", f"{L} SELECT {_LISTED} FROM elements WHERE lower(name) = 'nation_4'")(_ask("Where is NATION_4?"))
query("Q2_who_uses", f"{L} SELECT DISTINCT 'upstream' AS direction, rel_type, source_id AS id, e.name FROM rels JOIN elements e ON e.id = source_id WHERE target_id = 'nation:4'")(_ask("Who uses NATION_4"))
query("Q3_names_in_question", f"{L} SELECT {_LISTED} FROM elements WHERE name IN ('NATION_14', 'NATION_1', 'ASIA')")(_ask("Tell me about NATION_14 and ASIA"))
query("Q4_fallback", f"{L} SELECT {_LISTED}, 'ask what depends on a name, for a path, a stereotype or an overview' AS hint FROM elements WHERE ord < 1000000005")(_ask("zzz?"))


@query("Q1_structured", f"{L} SELECT {_LISTED} FROM elements WHERE stereotype = 'Entity'")
def q1(s, d):
    return Q.structured(lens.elements(s, d), lens.relationships(s, d), stereotype="entity")


@query(
    "Q2_reach",
    """SELECT 2 AS hops, 'customer:3 -> nation:' || n_nationkey || ' -> region:' || r_regionkey AS path, c_name || ' -> ' || n_name || ' -> ' || r_name AS names
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_custkey = 3""",
)
def reach(s, d):
    e, r = lens.elements(s, d), lens.relationships(s, d)
    out = None
    for region in ("africa", "america", "asia", "europe", "middle east"):  # one of them is reached
        spec = Q.Spec("path", ("customer:3", region))
        one = Q.answer(e, r, spec)
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "Q2_batch_of_questions",
    "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'upstream' WHEN 1 THEN 'downstream' WHEN 2 THEN 'stereotype' WHEN 3 THEN 'group' END AS mode FROM customer",
)
def batch(s, d):
    text = F.expr("CASE c_custkey % 5 WHEN 0 THEN 'What depends on ' || c_name || '?' WHEN 1 THEN 'dependencies of ' || c_name WHEN 2 THEN 'show all entities' WHEN 3 THEN 'a summary please' ELSE 'list the weather' END")
    return Q.read_all(lens.load(s, d, "customer").select("c_custkey", text.alias("question"))).select("c_custkey", "mode")
