"""Queries of extractors and text functions over source files made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as T
from ..operators import relational as R
from ..settings import Settings
from ..sources import extract as X
from ..sources import lens
from .registry import query

L = "WITH RECURSIVE " + lens.SQL


def _files(s, d, table, path, text):
    return lens.load(s, d, table).select(F.expr(path).alias("path"), F.expr(text).alias("text"))


def _java(s, d):
    return _files(
        s, d, "customer", "'src/Customer' || c_custkey || 'Service.java'",
        r"""'package com.acme.' || lower(c_mktsegment) || ';\nimport com.acme.base.Ledger;\n\n@Service\n@Scope("x")\npublic class Customer' || c_custkey || 'Service extends BaseService<Customer> implements Named, Billable {\n'
        || '  @Autowired private Nation' || c_nationkey || 'Repository repo;\n  public Customer' || c_custkey || 'Service(AuditLog log, String name) {}\n  public void pay(int x) { }\n  private int hide() { return 1; }\n}\n'""",
    )


_JAVA_ID = "'com.acme.' || lower(c_mktsegment) || '.Customer' || c_custkey || 'Service'"


@query("E1_E28_java_elements", f"SELECT {_JAVA_ID} AS id, 'Customer' || c_custkey || 'Service' AS name, 'Service' AS stereotype, 6 AS line_start, 'Service,Scope' AS annotations, 'BaseService' AS extends, 'Named,Billable' AS implements, 'pay' AS methods FROM customer")
def e1(s, d):
    e = X.elements_of(X.parsed(_java(s, d)))
    return e.select("id", "name", "stereotype", "line_start", *(F.array_join(c, ",").alias(c) for c in ("annotations", "implements", "methods")), "extends")


@query(
    "E2_java_edges",
    f"""SELECT {_JAVA_ID} AS source_id, unnest(['BaseService', 'Named', 'Billable', 'Nation' || c_nationkey || 'Repository', 'AuditLog', 'com.acme.base.Ledger']) AS target_id, unnest(['inherits', 'implements', 'implements', 'injects', 'injects', 'imports']) AS rel_type FROM customer""",
)
def e2(s, d):
    return X.edges_of(X.parsed(_java(s, d)))


def _ts(s, d):
    return _files(
        s, d, "nation", "'web/src/nation' || n_nationkey || '.ts'",
        r"""'import { Injectable, Inject as In } from ''@nestjs/common'';\nimport Base from ''./base'';\n\n@Injectable()\nexport class Nation' || n_nationkey || 'Api extends Base implements OnInit {\n'
        || '  constructor(private readonly region: Region' || n_regionkey || 'Repository, @Inject() log: Logger) {}\n}\n\nexport const Panel' || n_nationkey || ' = (props) => {\n  return (<div><Chart/><Chart/><Legend a={1}/></div>);\n};\n'""",
    )


@query(
    "E3_typescript_elements",
    "SELECT 'web.src.nation' || n_nationkey || '.Nation' || n_nationkey || 'Api' AS id, 'Nation' || n_nationkey || 'Api' AS name, 'Service' AS stereotype FROM nation UNION ALL SELECT 'web.src.nation' || n_nationkey || '.Panel' || n_nationkey, 'Panel' || n_nationkey, 'UI Component' FROM nation",
)
def e3(s, d):
    return X.elements_of(X.parsed(_ts(s, d))).select("id", "name", "stereotype")


@query(
    "E4_typescript_edges",
    """WITH e AS (SELECT *, 'web.src.nation' || n_nationkey || '.Nation' || n_nationkey || 'Api' AS api, 'web.src.nation' || n_nationkey || '.Panel' || n_nationkey AS panel FROM nation)
SELECT api AS source_id, unnest(['Base', 'OnInit', 'Region' || n_regionkey || 'Repository', 'Logger', 'Injectable', 'Inject', 'Base']) AS target_id, unnest(['inherits', 'implements', 'injects', 'injects', 'imports', 'imports', 'imports']) AS rel_type FROM e
UNION ALL SELECT panel, unnest(['Chart', 'Legend', 'Injectable', 'Inject', 'Base']), unnest(['composes', 'composes', 'imports', 'imports', 'imports']) FROM e""",
)
def e4(s, d):
    return X.edges_of(X.parsed(_ts(s, d)))


def _py(s, d):
    return _files(
        s, d, "supplier", "'app/services/s' || s_suppkey || '.py'",
        r"""'from app.models import Nation, Audit\n\nclass Supply' || s_suppkey || 'Worker(Base, Mixin):\n    def __init__(self, repo: Nation' || s_nationkey || 'Repo, n: int):\n        pass\n    def run(self):\n        pass\n    def _hidden(self):\n        pass\n\n'
        || '@router.get("/supply/' || s_suppkey || '")\nasync def show_' || s_suppkey || '(x=Depends(get_store)):\n    return x\n\ndef plain():\n    pass\n'""",
    )


@query(
    "E5_python_elements",
    "SELECT 'app.services.s' || s_suppkey || '.Supply' || s_suppkey || 'Worker' AS id, 'Worker' AS stereotype, 3 AS line_start, 'run' AS methods FROM supplier UNION ALL SELECT 'app.services.s' || s_suppkey || '.show_' || s_suppkey, 'Controller', 12, '' FROM supplier",
)
def e5(s, d):
    return X.elements_of(X.parsed(_py(s, d))).select("id", "stereotype", "line_start", F.array_join("methods", ",").alias("methods"))


@query(
    "E6_python_edges",
    """WITH e AS (SELECT *, 'app.services.s' || s_suppkey || '.Supply' || s_suppkey || 'Worker' AS w, 'app.services.s' || s_suppkey || '.show_' || s_suppkey AS f FROM supplier)
SELECT w AS source_id, unnest(['Base', 'Mixin', 'Nation' || s_nationkey || 'Repo', 'Nation', 'Audit']) AS target_id, unnest(['inherits', 'inherits', 'injects', 'imports', 'imports']) AS rel_type FROM e
UNION ALL SELECT f, unnest(['get_store', 'Nation', 'Audit']), unnest(['injects', 'imports', 'imports']) FROM e""",
)
def e6(s, d):
    return X.edges_of(X.parsed(_py(s, d)))


def _cobol(s, d):
    return _files(
        s, d, "part", "'cbl/PART' || p_partkey || '.cbl'",
        r"""'       IDENTIFICATION DIVISION.\n      * Prices of stock item number ' || p_partkey || '\n       PROGRAM-ID. PART' || p_partkey || '.\n       COPY SHARED' || p_size || '.\n       PROCEDURE DIVISION.\n'
        || '       MAIN-LINE.\n           CALL ''AUDIT'' USING X.\n           PERFORM STEP-A THRU STEP-B.\n           EXEC CICS LINK PROGRAM(''PRICE' || p_size || ''') END-EXEC.\n           EXEC SQL SELECT A INTO :B FROM SHOP.STOCK END-EXEC.\n'
        || '       STEP-A.\n           EXEC SQL UPDATE SALES SET X = 1 END-EXEC.\n           IF WS-AMOUNT > 100 THEN\n       STEP-B.\n           PERFORM VARYING I FROM 1 BY 1 UNTIL I > 3.\n'""",
    )


_PART = "'cobol.PART' || p_partkey"


@query("E9_cobol_elements", f"SELECT {_PART} AS id, 'program' AS kind, 'Component' AS c4_level FROM part UNION ALL SELECT {_PART} || '.para.' || unnest(['MAIN-LINE', 'STEP-A', 'STEP-B']), 'paragraph', 'Code' FROM part UNION ALL SELECT unnest(['db2.STOCK', 'db2.SALES']), 'db2_table', 'Component'")
def e9(s, d):
    return X.elements_of(X.parsed(_cobol(s, d))).select("id", "kind", "c4_level")


@query(
    "E8_E10_E11_cobol_edges",
    f"""WITH e AS (SELECT *, {_PART} AS p FROM part)
SELECT p AS source_id, unnest(['AUDIT', 'PRICE' || p_size, 'SHARED' || p_size, 'SHARED' || p_size, 'db2.STOCK', 'db2.SALES', p || '.para.MAIN-LINE', p || '.para.STEP-A', p || '.para.STEP-B']) AS target_id,
  unnest(['calls', 'cics_link', 'copies', 'imports', 'accesses_table', 'writes_table', 'composes', 'composes', 'composes']) AS rel_type FROM e
UNION ALL SELECT p || '.para.MAIN-LINE', p || '.para.' || unnest(['STEP-A', 'STEP-B']), 'performs' FROM e""",
)
def e10(s, d):
    return X.edges_of(X.parsed(_cobol(s, d)))


@query("E12_remarks", "SELECT 'cbl/PART' || p_partkey || '.cbl' AS path, 'Prices of stock item number ' || p_partkey AS remarks FROM part")
def e12(s, d):
    return _cobol(s, d).select("path", F.array_join(T.remarks(F.col("text")), "; ").alias("remarks"))


@query("E35_candidate_rules", "SELECT 'cbl/PART' || p_partkey || '.cbl' AS path, 'WS-AMOUNT > 100' AS rules FROM part")
def e35(s, d):
    return _cobol(s, d).select("path", F.array_join(T.candidate_rules(F.col("text"), F.lit("cobol")), "; ").alias("rules"))


@query("E7_normalised_cobol", r"SELECT p_partkey, 'MOVE ' || p_size || ' TO X.' || chr(10) || 'free form' AS text FROM part")
def e7(s, d):
    raw = F.expr(r"lpad(CAST(p_partkey AS STRING), 6, '0') || ' MOVE ' || p_size || ' TO X.\n000200* a comment line\nfree form'")
    return lens.load(s, d, "part").select("p_partkey", T.normalised_cobol(raw).alias("text"))


def _jcl(s, d):
    return _files(
        s, d, "orders", "'jcl/ORD' || o_orderkey || '.jcl'",
        r"""'//ORD' || o_orderkey || ' JOB (1),CLASS=A\n//S1 EXEC PGM=LOAD' || (o_custkey % 7) || '\n//IN DD DSN=SHOP.IN' || (o_custkey % 5) || ',DISP=SHR\n//OUT DD DSN=SHOP.OUT,DISP=(NEW,CATLG)\n//S2 EXEC PROC=NIGHTLY\n//S3 EXEC PGM=REPORT\n//R DD DSN=SHOP.OUT,DISP=OLD\n'""",
    )


@query("E13_jcl_elements", "SELECT 'jcl.ORD' || o_orderkey AS id, 'jcl_job' AS kind FROM orders UNION ALL SELECT 'jcl.ORD' || o_orderkey || '.' || unnest(['S1', 'S2', 'S3']), 'jcl_step' FROM orders UNION SELECT 'cobol.LOAD' || (o_custkey % 7), 'program_ref' FROM orders UNION SELECT unnest(['cobol.REPORT']), 'program_ref' UNION SELECT 'dataset.SHOP.IN' || (o_custkey % 5), 'dataset' FROM orders UNION SELECT 'dataset.SHOP.OUT', 'dataset'")
def e13(s, d):
    return X.elements_of(X.parsed(_jcl(s, d))).select("id", "kind")


@query(
    "E14_jcl_edges",
    """WITH e AS (SELECT *, 'jcl.ORD' || o_orderkey AS j FROM orders)
SELECT j AS source_id, j || '.' || unnest(['S1', 'S2', 'S3']) AS target_id, 'composes' AS rel_type FROM e
UNION ALL SELECT j || '.S1', unnest(['LOAD' || (o_custkey % 7), 'dataset.SHOP.IN' || (o_custkey % 5), 'dataset.SHOP.OUT']), unnest(['executes', 'reads_dataset', 'writes_dataset']) FROM e
UNION ALL SELECT j || '.S2', 'NIGHTLY', 'calls' FROM e UNION ALL SELECT j || '.S3', unnest(['REPORT', 'dataset.SHOP.OUT']), unnest(['executes', 'reads_dataset']) FROM e""",
)
def e14(s, d):
    return X.edges_of(X.parsed(_jcl(s, d)))


@query("E15_bms", "WITH m AS (SELECT 'bms.MAP' || r_regionkey AS m FROM region) SELECT m AS source_id, m || '.field.' || unnest(['NAME', 'TOTAL']) AS target_id, 'composes' AS rel_type FROM m")
def e15(s, d):
    return X.edges_of(X.parsed(_files(s, d, "region", "'bms/R' || r_regionkey || '.bms'", r"'MAP' || r_regionkey || ' DFHMDI SIZE=(24,80)\nNAME DFHMDF POS=(1,1)\nTOTAL DFHMDF POS=(2,1)\n'")))


@query(
    "E16_E21_java_entities",
    "SELECT 'Part' || p_partkey || 'Entity' AS name, 'Entity' AS stereotype, 'PART_' || p_partkey AS table_name, 'partId,BRAND_ID,supplierId' AS columns, 'partId,BRAND_ID,supplierId' AS fk_columns FROM part",
)
def e16(s, d):
    text = r"""'@Entity\n@Table(name = "PART_' || p_partkey || '")\npublic class Part' || p_partkey || 'Entity {\n  @Id private Long partId;\n  @Column(name = "BRAND_ID") private Long brand;\n  @ManyToOne private Long supplierId;\n}\n'"""
    e = X.elements_of(X.parsed(_files(s, d, "part", "'m/Part' || p_partkey || 'Entity.java'", text)))
    return e.select("name", "stereotype", "table_name", F.array_join("columns", ",").alias("columns"), F.array_join("fk_columns", ",").alias("fk_columns"))


@query("E18_python_entities", "SELECT 'Part' || p_partkey AS name, 'part_' || p_partkey AS table_name, 'id,brand,brand_id,size' AS columns, 'sqlalchemy' AS kind FROM part")
def e18(s, d):
    text = r"""'class Part' || p_partkey || '(Base):\n    __tablename__ = "part_' || p_partkey || '"\n    id = Column(Integer, primary_key=True)\n    brand = Column(Integer, ForeignKey("brand.id"))\n    size: int = 0\n'"""
    return X.elements_of(X.parsed(_files(s, d, "part", "'m/part' || p_partkey || '.py'", text))).select("name", "table_name", F.array_join("columns", ",").alias("columns"), "kind")


@query("E19_cobol_tables", "SELECT 'PART_' || p_partkey AS table_name, 'PART_ID,BRAND_NAME' AS columns, 'dclgen' AS kind FROM part")
def e19(s, d):
    text = r"""'           EXEC SQL DECLARE SHOP.PART_' || p_partkey || ' TABLE\n           ( PART_ID INTEGER NOT NULL,\n             BRAND_NAME CHAR(10)\n           ) END-EXEC.\n'"""
    return X.elements_of(X.parsed(_files(s, d, "part", "'dcl/P' || p_partkey || '.dcl'", text))).where("kind = 'dclgen'").select("table_name", F.array_join("columns", ",").alias("columns"), "kind")


@query(
    "E24_E25_E26_stereotypes",
    f"""{L}, n AS (SELECT id, 'X' || regexp_extract(id, '[0-9]+') || CASE ord % 5 WHEN 0 THEN 'ServiceImpl' WHEN 1 THEN 'Client' WHEN 2 THEN 'Thing' WHEN 3 THEN 'Filter' ELSE 'Model' END AS name,
  CASE WHEN ord % 3 = 0 THEN 'a/repos/b.java' ELSE 'a/b.java' END AS path, ord FROM elements)
SELECT id, CASE WHEN ord % 11 = 0 THEN 'Configuration' WHEN ord % 13 = 0 THEN 'Repository' WHEN ord % 5 = 0 THEN 'Service' WHEN ord % 5 = 1 THEN 'Gateway' WHEN ord % 5 = 3 THEN 'Middleware' WHEN ord % 5 = 4 THEN 'Entity' WHEN ord % 3 = 0 THEN 'Repository' ELSE 'Component' END AS stereotype FROM n""",
)
def e24(s, d):
    e = lens.elements(s, d)
    none = F.array().cast("array<string>")
    name = F.concat(F.lit("X"), F.regexp_extract("id", "[0-9]+", 0), F.expr("CASE ord % 5 WHEN 0 THEN 'ServiceImpl' WHEN 1 THEN 'Client' WHEN 2 THEN 'Thing' WHEN 3 THEN 'Filter' ELSE 'Model' END"))
    notes = F.when(F.col("ord") % 11 == 0, F.array(F.lit("Deprecated"), F.lit("@Configuration(x)"))).otherwise(none)
    bases = F.when(F.col("ord") % 13 == 0, F.array(F.lit("org.data.JpaRepository"))).otherwise(none)
    path = F.when(F.col("ord") % 3 == 0, "a/repos/b.java").otherwise("a/b.java")
    return e.select("id", N.stereotype(F.lit("java"), name, path, notes, bases).alias("stereotype"))


@query("F7_make_id", f"{L} SELECT id, replace(regexp_replace(file_path, '\\.[^./]+$', ''), '/', '.') || '.' || name AS made FROM elements WHERE stereotype IN ('Service', 'Entity')")
def f7(s, d):
    return lens.elements(s, d).where("stereotype IN ('Service', 'Entity')").select("id", N.make_id(F.col("file_path"), F.col("name")).alias("made"))


@query("E22_E23_table_names", "SELECT p_partkey, 'Part' AS fk_table, 'Brand' || p_size AS of_name FROM part")
def e22(s, d):
    p = lens.load(s, d, "part")
    return p.select("p_partkey", N.fk_target(F.lit("Part_ID")).alias("fk_table"), N.table_of(F.concat(F.lit("Brand"), "p_size", F.lit("Entity"))).alias("of_name"))


_BARE = r"trim(regexp_replace(x, '^\s*(/\*\*?|\*/|\*|//+|#+)\s?', ''))"
_LICENCE = "regexp_matches(lower(x), 'licen[sc]ed under|copyright|all rights reserved|apache licen[sc]e|spdx')"


@query(
    "E37_excerpts",
    rf"""WITH b AS (SELECT doc_id, list_transform(string_split(replace(text, chr(13), ''), chr(10)), lambda x: {_BARE}) AS ls FROM documents),
j AS (SELECT doc_id, array_to_string(list_filter(ls, lambda x: length(x) >= 8 AND NOT {_LICENCE} AND NOT regexp_matches(x, '(?i)^(import|from|package|using|#include|identification division|environment division)\b') AND regexp_matches(x, '[A-Za-z]'))[1:4], ' ') AS t FROM b)
SELECT doc_id, CASE WHEN length(t) <= 280 THEN t ELSE regexp_replace(left(t, 280), '\s+\S*$', '') || '…' END AS excerpt FROM j""",
)
def e37(s, d):
    return lens.load(s, d, "documents").select("doc_id", T.excerpt(F.col("text")).alias("excerpt"))


@query("F17_licence_lines", f"SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: {_LICENCE}))::INT AS n FROM documents")
def f17(s, d):
    return lens.load(s, d, "documents").select("doc_id", F.size(F.filter(F.split("text", "\n"), N.is_licence)).alias("n"))


@query("E34_doc_comments", "SELECT c_custkey, 'Pays for order ' || c_custkey || '. Twice if needed.' AS docs FROM customer")
def e34(s, d):
    text = F.expr(r"'/**\n * Pays for order ' || c_custkey || '.\n * Twice if needed.\n * @param x what\n * Licensed under the Any License\n */\nclass X {}'")
    return lens.load(s, d, "customer").select("c_custkey", F.array_join(T.doc_comments(text), "; ").alias("docs"))


@query("E36_transactions", "SELECT 'P' || s_suppkey AS transaction, 'PROG' || s_nationkey AS program FROM supplier")
def e36(s, d):
    text = F.expr(r"'DEFINE TRANSACTION(P' || s_suppkey || ') GROUP(G)\n  PROGRAM(PROG' || s_nationkey || ')'")
    return lens.load(s, d, "supplier").select(F.explode(T.transactions(text)).alias("t")).select("t.*")


@query(
    "S5_J2_scan_and_resolve",
    "SELECT 'com.acme.' || lower(c_mktsegment) || '.Customer' || c_custkey || 'Service' AS source_id, 'com.acme.geo.Nation' || c_nationkey || 'Repository' AS target_id, 'injects' AS rel_type FROM customer",
)
def scan(s, d):
    """Two languages' worth of files, extracted and resolved: only targets that exist stay."""
    repos = _files(s, d, "nation", "'src/Nation' || n_nationkey || 'Repository.java'", r"'package com.acme.geo;\npublic interface Nation' || n_nationkey || 'Repository extends JpaRepository<Nation, Long> {\n}\n'")
    both = X.parsed(_java(s, d).unionByName(repos))
    return R.resolve_names(X.edges_of(both), X.elements_of(both)).select("source_id", "target_id", "rel_type")


_SETTINGS = Settings.of({
    "stereotypes": {"java": [{"annotation": "deprecated", "stereotype": "Legacy"}, {"convention": "a/repos/**", "stereotype": "Store"}]},
    "containers": [{"path": "src/main/java/com/acme/geo/*", "name": "geography"}, {"path": "services/supply/**", "name": "supply"}, {"path": "schema", "name": "tables"}],
    "mainframe": {"stereotypes": [{"program": "part7", "stereotype": "Gateway"}, {"program_pattern": "PART1*", "stereotype": "Controller"}], "transactions": {"px01": "price1"}},
})


@query(
    "M1_custom_stereotypes",
    f"""{L} SELECT id, CASE WHEN ord % 11 = 0 THEN 'Legacy' WHEN ord % 5 = 0 THEN 'Service' WHEN ord % 3 = 0 THEN 'Store' ELSE 'Component' END AS stereotype FROM elements""",
)
def m1(s, d):
    """Custom annotations come before built-in ones, custom folders before built-in ones but after the name."""
    e = lens.elements(s, d)
    none = F.array().cast("array<string>")
    name = F.concat(F.lit("X"), F.regexp_extract("id", "[0-9]+", 0), F.when(F.col("ord") % 5 == 0, F.lit("ServiceImpl")).otherwise(F.lit("Thing")))
    notes = F.when(F.col("ord") % 11 == 0, F.array(F.lit("Configuration"), F.lit("@x.Deprecated(y)"))).otherwise(none)
    path = F.when(F.col("ord") % 3 == 0, "a/repos/b.java").otherwise("a/b.java")
    java = F.lit("java")
    return e.select("id", N.stereotype(java, name, path, notes, none, _SETTINGS.by_annotation(notes, java), _SETTINGS.by_convention(path, java)).alias("stereotype"))


@query(
    "P8_container_mappings",
    f"""{L} SELECT id, CASE WHEN file_path LIKE 'src/main/java/com/acme/geo/%' THEN 'geography' WHEN file_path LIKE 'services/supply/%' THEN 'supply' WHEN file_path LIKE 'schema/%' THEN 'tables' END AS container FROM elements""",
)
def p8(s, d):
    return lens.elements(s, d).select("id", _SETTINGS.container(F.col("file_path")).alias("container"))


@query(
    "E27_host_stereotypes",
    """SELECT 'cobol.PART' || p_partkey AS id, CASE WHEN p_partkey = 7 THEN 'Gateway' WHEN p_partkey::VARCHAR LIKE '1%' THEN 'Controller'
  WHEN p_size % 5 = 0 THEN 'UI Component' WHEN p_size % 5 = 1 THEN 'Gateway' WHEN p_size % 5 IN (2, 3) THEN 'Repository' ELSE 'Component' END AS stereotype FROM part""",
)
def e27(s, d):
    """Programs with maps, queues, tables, files or nothing; overrides come first."""
    body = r"""CASE p_size % 5 WHEN 0 THEN '           EXEC CICS SEND MAP(''M1'') END-EXEC.\n           EXEC SQL UPDATE SALES SET X = 1 END-EXEC.\n' WHEN 1 THEN '           CALL ''MQPUT'' USING X.\n'
        WHEN 2 THEN '           EXEC SQL SELECT A INTO :B FROM STOCK END-EXEC.\n' WHEN 3 THEN '           READ CUST-FILE.\n' ELSE '           MOVE A TO B.\n' END"""
    text = r"'       PROGRAM-ID. PART' || p_partkey || '.\n       PROCEDURE DIVISION.\n' || " + body
    files = _files(s, d, "part", "'cbl/PART' || p_partkey || '.cbl'", text)
    return X.elements_of(X.parsed(files), _SETTINGS).where("kind = 'program'").select("id", "stereotype")


@query(
    "C13_host_pass",
    f"""SELECT 'cobol.PART' || p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'Service' WHEN p_partkey % 4 = 1 THEN 'Batch Job' ELSE 'Component' END AS stereotype FROM part""",
)
def c13(s, d):
    """Of four programs one is linked from another, one executed by a job, and two aren't known to be called."""
    program = _files(s, d, "part", "'cbl/PART' || p_partkey || '.cbl'", r"'       PROGRAM-ID. PART' || p_partkey || '.\n       PROCEDURE DIVISION.\n' || CASE WHEN p_partkey % 4 = 3 THEN '           EXEC CICS LINK PROGRAM(''PART' || (p_partkey - 3) || ''') END-EXEC.\n' ELSE '' END")
    extra = _files(s, d, "part", "'cbl/LAST' || p_partkey || '.cbl'", r"'       PROGRAM-ID. LAST' || p_partkey || '.\n       PROCEDURE DIVISION.\n           EXEC CICS LINK PROGRAM(''PART' || (p_partkey - p_partkey % 4) || ''') END-EXEC.\n'")
    job = _files(s, d, "part", "'jcl/J' || p_partkey || '.jcl'", r"'//J' || p_partkey || ' JOB\n//S1 EXEC PGM=' || CASE WHEN p_partkey % 4 = 1 THEN 'PART' ELSE 'NONE' END || p_partkey || '\n'")
    both = X.parsed(program.unionByName(extra).unionByName(job)).persist()
    e = X.elements_of(both).where("kind <> 'program_ref'")
    edges = R.resolve_names(X.edges_of(both), e)
    return R.host_pass(e, edges).where("id LIKE 'cobol.PART%'").select("id", "stereotype")


@query("E10_transactions", "SELECT 'cobol.START' || p_partkey AS source_id, CASE WHEN p_size % 2 = 0 THEN 'PRICE1' ELSE 'PX02' END AS target_id, 'cics_start' AS rel_type FROM part")
def e10(s, d):
    text = r"'       PROGRAM-ID. START' || p_partkey || '.\n       PROCEDURE DIVISION.\n           EXEC CICS START TRANSID(''' || CASE WHEN p_size % 2 = 0 THEN 'PX01' ELSE 'PX02' END || ''') END-EXEC.\n'"
    return X.edges_of(X.parsed(_files(s, d, "part", "'cbl/S' || p_partkey || '.cbl'", text), transactions=_SETTINGS.transactions))


@query("C5_step_programs", "SELECT 'step' AS section, 'jcl.J' || o_orderkey || '.S1' AS name, 'PGM' || o_custkey AS program FROM orders UNION ALL SELECT 'transaction', 'P' || s_suppkey, 'PROG' || s_nationkey FROM supplier")
def c5_steps(s, d):
    from ..overlays import step_programs

    both = X.parsed(_files(s, d, "orders", "'jcl/J' || o_orderkey || '.jcl'", r"'//J' || o_orderkey || ' JOB\n//S1 EXEC PGM=PGM' || o_custkey || '\n'"))
    texts = lens.load(s, d, "supplier").select(F.expr(r"'DEFINE TRANSACTION(P' || s_suppkey || ') GROUP(G)\n  PROGRAM(PROG' || s_nationkey || ')'").alias("text"))
    return step_programs(X.elements_of(both), X.edges_of(both), texts)


@query(
    "F6_F9_F12_names",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'supply-' || s_suppkey ELSE 'repo-' || s_suppkey END AS slug,
  CASE WHEN s_nationkey = 3 THEN 'NationThree' WHEN s_suppkey % 3 = 0 THEN 'nation_' || s_nationkey ELSE 'Nation_' || s_nationkey END AS display, 'a|b|' || s_suppkey AS parts FROM supplier""",
)
def names(s, d):
    key = F.expr("'nation_' || s_nationkey")
    project = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("Supply "), "s_suppkey")).otherwise("My Application")
    path = F.concat(F.lit("/x/y/Repo_"), "s_suppkey", F.lit("/"))
    shown = F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.concat(F.lit("Nation_"), "s_nationkey"))
    key = F.when(F.col("s_nationkey") == 3, "nationthree").otherwise(key)
    return lens.load(s, d, "supplier").select("s_suppkey", N.repo_slug(project, path).alias("slug"), N.display_name(key, shown, ["NationThree"]).alias("display"), F.array_join(N.split_list(F.concat(F.lit(" a, b,,"), "s_suppkey")), "|").alias("parts"))
