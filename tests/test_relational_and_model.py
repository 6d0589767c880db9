from __future__ import annotations

from pyspark.sql import functions as F

from orrery import query as Q
from orrery.functions import names as N
from orrery.operators import model as M
from orrery.operators import relational as R


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())).select(column.alias("x")).first()["x"]


SNAP = "id string, name string, stereotype string, file_path string, annotations array<string>, extends string"


def test_difference(spark):
    old = table(spark, [("A", "A", "Service", "a", ["x", "y"], None), ("B", "B", "Service", "b", [], None), ("D", "D", "Entity", "d", ["p", "q"], "X")], SNAP)
    new = table(spark, [("A", "A", "Controller", "a", ["y", "x", "x"], "Base"), ("C", "C", "Service", "c", [], None), ("D", "D", "Entity", "d", ["q", "p"], "X")], SNAP)
    got = {(r["id"], r["change_type"], r["diff_summary"]) for r in R.difference(old, new).collect()}
    assert got == {("A", "modified", "stereotype Service => Controller; extends none => Base"), ("B", "removed", ""), ("C", "added", "")}
    back = {(r["id"], r["change_type"]) for r in R.difference(new, old).collect()}
    assert {i for i, c in back if c == "removed"} == {"C"} and {i for i, c in back if c == "added"} == {"B"}
    assert tuple(R.difference_summary(R.difference(old, new)).first()) == (1, 1, 1, True)
    assert R.difference(old, old).count() == 0 and not R.difference_summary(R.difference(old, old)).first()["has_changes"]


def test_resolution(spark):
    e = table(spark, [(1, "a.X", "X", "java", []), (2, "b.X", "X", "python", []), (3, "a.Y", "Y", "java", []), (4, "a.Impl", "Impl", "java", ["X"])], "ord long, id string, name string, language string, implements array<string>")
    r = table(spark, [("a.Y", "lib.X", "calls"), ("b.X", "X", "calls"), ("a.Y", "a.X", "injects"), ("a.Y", "gone.Z", "calls")], "source_id string, target_id string, rel_type string")
    got = {tuple(x) for x in R.resolve_names(r, e).collect()}
    assert got == {("a.Y", "a.X", "calls", True), ("b.X", "b.X", "calls", True), ("a.Y", "a.X", "injects", False)}
    assert {tuple(x) for x in R.interface_edges(r, e).collect()} == {("a.Y", "a.Impl", "injects")}


def test_aggregate(spark):
    e = table(spark, [("S", "Component", None), ("T", "Component", "web")], "id string, c4_level string, container string")
    r = table(spark, [("S", "T", "calls")], "source_id string, target_id string, rel_type string")
    es, rs = R.aggregated({"billing": (e, r), "orders": (e, r)})
    assert {x["id"] for x in es.collect()} == {"billing::S", "billing::T", "orders::S", "orders::T"} and es.count() == 4
    assert {(x["source_id"], x["target_id"]) for x in rs.collect()} == {("billing::S", "billing::T"), ("orders::S", "orders::T")}
    assert {(x["container"]) for x in es.where("id LIKE '%S'").collect()} == {"billing", "orders"}


ENT = "ord long, id string, name string, stereotype string, table_name string, columns array<string>, fk_columns array<string>, kind string"


def test_data_model(spark):
    e = table(
        spark,
        [(1, "u", "User", "Entity", "users", ["id", "name"], [], "jpa"), (2, "c", "Customer", "Entity", "customers", ["id", "mail"], [], None), (3, "o", "Order", "Entity", "orders", ["id", "customers_id"], ["customers_id"], "jpa"), (4, "s", "Svc", "Service", None, [], [], None), (5, "t", "Tmp", "Entity", "tmp_x", [], [], None)],
        ENT,
    )
    entities = M.cdm_entities(e, same_as={"Party": ["users", "customers"]}, suppress=["tmp_*"])
    got = {r["canonical"]: (r["name"], r["columns"], r["aliases"], r["members"]) for r in entities.collect()}
    assert got == {"Party": ("User", ["id", "name", "mail"], ["customers", "users"], 2), "orders": ("Order", ["id", "customers_id"], [], 1)}
    assert [tuple(r) for r in M.cdm_associations(entities, same_as={"Party": ["users", "customers"]}).collect()] == [("orders", "Party", "customers_id")]
    files = table(spark, [("a.sql", "CREATE TABLE orders (\n id INT,\n total DECIMAL(9,2),\n PRIMARY KEY (id)\n);\ncreate table Extra (x int)")], "path string, text string")
    tables = M.merged_tables(M.ddl_tables(files))
    assert {r["name"]: r["columns"] for r in tables.collect()} == {"orders": ["id", "total"], "Extra": ["x"]}
    assert {r["name"]: r["columns"] for r in M.ddl_tables(files, compat=True).collect()} == {"orders": ["id", "total"], "Extra": ["x"]}
    drift = {r["name"]: (r["status"], r["not_in_model"], r["not_in_schema"]) for r in M.schema_drift(tables, entities).collect()}
    assert drift == {"orders": ("columns", "total", "customers_id"), "Extra": ("schema_only", "", ""), "Party": ("model_only", "", "")}


def test_topics_and_contracts(spark):
    files = table(
        spark,
        [("p.java", 'kafkaTemplate.send("orders", x); rabbitTemplate.convertAndSend("q1", y)'), ("c.java", '@KafkaListener(groupId = "g", topics = {"orders"}) void on() {}'), ("k.py", "from aiokafka import AIOKafkaProducer"), ("h.py", 'httpx.get("http://api-service/users/123?x=1")\nrequests.post("/users")'), ("w.ts", "await axios.delete(`/users/{id}/`); fetch('/ping')")],
        "path string, text string",
    )
    ends = M.endpoints(files)
    assert {tuple(r) for r in ends.collect()} == {("p.java", "producer", "Kafka", "orders"), ("p.java", "producer", "RabbitMQ", "q1"), ("c.java", "consumer", "Kafka", "orders"), ("k.py", "producer", "Kafka", "kafka-unknown")}
    assert [tuple(r) for r in M.topic_edges(ends).collect()] == [("p.java", "c.java", "publishes_to", "orders")]
    calls = M.call_sites(files)
    assert {(r["method"], r["path"]) for r in calls.collect()} == {("GET", "/users/123"), ("POST", "/users"), ("DELETE", "/users/{id}"), ("GET", "/ping")}
    ops = M.operations(table(spark, [("users", '{"paths": {"/users/{id}": {"get": {}, "delete": {}}, "/users": {"get": {}}}}'), ("bad", "[1")], "service string, text string"))
    assert {(r["method"], r["path"], r["template"]) for r in M.contract_links(calls, ops).collect()} == {("GET", "/users/123", "/users/{id}"), ("DELETE", "/users/{id}", "/users/{id}")}


def test_scalars(spark):
    c = F.col
    title = lambda n, s: one(spark, N.guess_title(c("n"), c("s")), n=n, s=s)
    assert [title("UserRestController", "Controller"), title("PAYROLL", "Batch Job"), title("nightlyBatch", "Batch Job"), title("ApiGateway", "Gateway")] == ["User", "PAYROLL", "Nightly batch", "Api gateway"]
    assert one(spark, N.capability_id(c("n")), n=" Pay & Go! ") == "pay-go" and one(spark, N.capability_id(c("n")), n="!!") == "capability"
    token = lambda p, lang="java": one(spark, N.package_token(c("p"), c("l")), p=p, l=lang)
    assert [token("src/main/java/com/acme/billing/A.java"), token("app/modules/pay-roll/x.ts", "typescript"), token("tests/unit/x.py", "python")] == ["billing", "pay_roll", "unit"]
    assert [one(spark, N.url_path(c("u")), u=u) for u in ("http://h/a/b/?q=1", "x/y", "https://h")] == ["/a/b", "/x/y", "/"]
    assert [one(spark, N.fk_target(c("f")), f=f) for f in ("C_Order_ID", "user_id", "userId", "Id", "x")] == ["C_Order", "user", "user", "Id", "x"]
    assert [one(spark, N.table_of(c("f")), f=f) for f in ("I_C_Order", "DCLCUST", "UserEntity", "Model", "Plain")] == ["C_Order", "CUST", "User", "Model", "Plain"]
    kind = lambda lang, n, p, a, b: one(spark, N.stereotype(c("l"), c("n"), c("p"), c("a"), c("b")), l=lang, n=n, p=p, a=a, b=b)
    assert kind("java", "X", "x", ["Deprecated", "RestController"], []) == "Controller" and kind("java", "X", "x", [], ["JpaRepository"]) == "Repository"
    assert kind("python", "OrderService", "x", [], []) == "Service" and kind("python", "Thing", "app/repos/thing.py", [], []) == "Repository" and kind("python", "Thing", "x", [], []) == "Component"
    assert kind("typescript", "Home", "x", [], ["React.PureComponent"]) == "UI Component" and kind("java", "I_C_Order", "x", [], []) == "Entity"
    assert one(spark, N.excluded(c("p"), ["node_modules", "*.min.js"]), p="a/node_modules/b.js") and one(spark, N.excluded(c("p"), ["node_modules", "*.min.js"]), p="x/a.min.js") and not one(spark, N.excluded(c("p"), ["node_modules"]), p="a/b.js")


def test_questions():
    assert Q.parse("List all repositories") == Q.Spec("stereotype", ("Repository",))
    assert Q.parse("what depends on UserService?") == Q.Spec("upstream", ("userservice",))
    assert Q.parse("how does A reach B") == Q.Spec("path", ("a", "b")) and Q.parse("trace from Web to Users") == Q.Spec("path", ("web", "users"))
    assert Q.parse("list the weather") is None and Q.parse("") == Q.Spec("all") and Q.parse("give me a summary") == Q.Spec("group")


def test_capability_merge(spark):
    cap = "id string, title string, element string, status string"
    found = table(spark, [("pay", "Pay", "PayController", "proposed"), ("new", "New", "NewJob", "proposed")], cap)
    old = table(spark, [("pay", "Payments", "PayController", "approved"), ("job-7", "Seven", "NewJob", "rejected"), ("gone", "Gone", "Gone", "approved")], cap)
    got = {tuple(r) for r in M.merged_capabilities(old, found).collect()}
    assert got == {("pay", "Payments", "PayController", "approved", False), ("job-7", "Seven", "NewJob", "rejected", False), ("gone", "Gone", "Gone", "approved", True)}


def test_topic_edges_of_large_topics(spark, monkeypatch):
    """All pairs once, whatever the blocks; a topic is no key of the join by itself, else it would be one task's."""
    from orrery.operators import model as M

    monkeypatch.setattr(M, "BLOCK", (10, 2))
    ends = spark.createDataFrame([(f"p{k}", "producer", "Kafka", "t") for k in range(200)] + [(f"c{k}", "consumer", "Kafka", "t") for k in range(7)] + [("p0", "consumer", "Kafka", "t"), ("p1", "producer", "Kafka", "u"), ("p1", "producer", "SQS", "u"), ("c1", "consumer", "Kafka", "u"), ("x", "producer", "Kafka", "v")], "file_path string, role string, technology string, topic string")
    pairs = M.topic_edges(ends)
    got = sorted((r["source_id"], r["target_id"], r["topic"]) for r in pairs.collect())
    want = {(f"p{k}", c, "t") for k in range(200) for c in [*(f"c{j}" for j in range(7)), "p0"] if c != f"p{k}"} | {("p1", "c1", "u")}
    assert got == sorted(want)
    joins = [x for x in pairs._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x and "target_id" in x and "source_id" in x]
    assert len(joins) == 1 and joins[0].count(" = ") >= 4
