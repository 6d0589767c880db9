"""Queries of the composed analyses over the lens."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import overlays as O
from ..sources import extract as X
from ..sources import lens
from .graph import ids
from .registry import query
from .sources import _cobol, _jcl

L = "WITH RECURSIVE " + lens.SQL


@query("C4_harvest", "WITH c AS (SELECT 'cbl/PART' || p_partkey || '.cbl' AS f, 'Prices of stock item number ' || p_partkey AS t FROM part) SELECT f AS file_path, 'comment' AS section, t AS text FROM (SELECT * FROM c ORDER BY f LIMIT 12) UNION ALL SELECT min(f), 'rule', 'WS-AMOUNT > 100' FROM c")
def c4(s, d):
    files = _cobol(s, d).withColumn("language", F.lit("cobol"))
    return O.harvest(files.select(F.col("path").alias("file_path")), files)


@query(
    "C5_operations_overlay",
    """WITH j AS (SELECT 'ORD' || o_orderkey AS name, 'jcl/ORD' || o_orderkey || '.jcl' AS f FROM orders), r AS (SELECT 'job' AS section, name, row_number() OVER (ORDER BY f, name)::INT AS k FROM j)
SELECT * FROM r WHERE k <= 20 UNION ALL SELECT 'step', unnest(['S1', 'S2', 'S3']), unnest([1, 2, 3])""",
)
def c5(s, d):
    return O.operations_overlay(X.elements_of(X.parsed(_jcl(s, d))))


@query("G22_fine_grain", "SELECT unnest(['paragraph', 'paragraph', 'paragraph', 'perform', 'perform', 'copy']) AS section, unnest(['cobol.PART7', 'cobol.PART7', 'cobol.PART7', 'cobol.PART7.para.MAIN-LINE', 'cobol.PART7.para.MAIN-LINE', 'cobol.PART7']) AS source_id, unnest(['cobol.PART7.para.MAIN-LINE', 'cobol.PART7.para.STEP-A', 'cobol.PART7.para.STEP-B', 'cobol.PART7.para.STEP-A', 'cobol.PART7.para.STEP-B', (SELECT 'SHARED' || p_size FROM part WHERE p_partkey = 7)]) AS target_id")
def g22(s, d):
    both = X.parsed(_cobol(s, d))
    return O.fine_grain(X.elements_of(both), X.edges_of(both), ids(s, "cobol.PART7"))


@query("P12_test_files", f"{L} SELECT DISTINCT 'src/test/' || name || 'Test.java' AS path FROM elements WHERE id IN ('nation:3', 'customer:5')")
def p12(s, d):
    e = lens.elements(s, d).where("stereotype IN ('Repository', 'Service')")
    files = e.select(F.concat(F.lit("src/test/"), "name", F.lit("Test.java")).alias("path"), F.concat(F.lit("check("), "name", F.lit(")")).alias("text"))
    return O.tests_of(e, files, e.where("id IN ('nation:3', 'customer:5')"))


@query("M2_cautions", f"{L} SELECT 'Entry point, mind its callers: ' || name AS note FROM elements WHERE id = 'orders:1' UNION SELECT 'Runs in batch, mind its schedule: ' || name FROM elements WHERE id = 'orders:1' AND stereotype = 'Batch Job'")
def m2(s, d):
    from ..operators import graph as G

    e, r, seeds = lens.elements(s, d), lens.relationships(s, d), ids(s, "orders:1")
    return O.cautions(e, G.impact(e, r, seeds, 1), seeds)


@query("C6_playbook")
def c6(s, d):
    return O.playbook(lens.elements(s, d), lens.relationships(s, d), ids(s, "orders:1"))
