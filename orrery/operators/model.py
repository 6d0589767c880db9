"""Canonical data model, schema drift, domains, capabilities, intents, topics and API contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..schema import ENTRY, MAPPED
from .relational import with_container

def _no_texts() -> Column:
    return F.array().cast("array<string>")


def _ordered_union(column: str, order: str) -> Column:
    """The distinct values of arrays, in order of first appearance."""
    rows = F.array_sort(F.collect_list(F.struct(order, column)))
    return F.array_distinct(F.flatten(F.transform(rows, lambda r: r[column])))


def canonical(name: Column, aliases: dict[str, str], same_as: dict[str, list[str]]) -> Column:
    """The canonical name of a table: an alias without case, else the group it is a member of, else itself."""
    pairs = {a.lower(): c for a, c in aliases.items()}
    for c, members in same_as.items():
        for m in members:
            pairs.setdefault(m.lower(), c)
    if not pairs:
        return name
    return F.coalesce(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[F.lower(name)], name)


def entity_score(name: Column) -> Column:
    mapped = F.col("kind").isin(MAPPED)
    size = 2 * F.size("columns") + F.size("fk_columns")
    return size + F.when(name.startswith("I_"), 1000).otherwise(0) + F.when(F.col("table_name").isNotNull(), 50).otherwise(0) + F.when(mapped, 25).otherwise(0)


def cdm_entities(elements: DataFrame, aliases: dict[str, str] | None = None, same_as: dict[str, list[str]] | None = None, suppress: list[str] | None = None) -> DataFrame:
    """One row for each canonical table: canonical, name (of the best element), columns, fk_columns, aliases, members."""
    table = F.coalesce("table_name", N.table_of(F.col("name")))
    e = elements.where("stereotype = 'Entity'").withColumn("table", table)
    if suppress:
        e = e.where(~N.matches_any(F.lower("table"), [s.lower() for s in suppress]))
    e = e.withColumn("canonical", canonical(F.col("table"), aliases or {}, same_as or {})).withColumn("score", entity_score(F.col("name")))
    other = F.when(F.lower("table") != F.lower("canonical"), F.col("table"))
    best = F.max_by(F.struct("name", "canonical", "id"), F.struct("score", -F.col("ord")))
    return e.groupBy(F.lower("canonical").alias("key")).agg(
        best.alias("best"), _ordered_union("columns", "ord").alias("columns"), _ordered_union("fk_columns", "ord").alias("fk_columns"), F.array_sort(F.collect_set(other)).alias("aliases"), F.count(F.lit(1)).alias("members"),
    ).select("key", F.col("best.canonical").alias("canonical"), F.col("best.name").alias("name"), F.col("best.id").alias("best_id"), "columns", "fk_columns", "aliases", "members")


def cdm_associations(entities: DataFrame, aliases: dict[str, str] | None = None, same_as: dict[str, list[str]] | None = None) -> DataFrame:
    """source, target and fk for every key column that leads to another canonical table."""
    keys = entities.select(F.col("canonical").alias("source"), F.col("key").alias("source_key"), F.explode("fk_columns").alias("fk"))
    keys = keys.withColumn("key", F.lower(canonical(N.fk_target(F.col("fk")), aliases or {}, same_as or {})))
    return keys.join(entities.select("key", F.col("canonical").alias("target")), "key").where("key <> source_key").select("source", "target", "fk").distinct()


def cdm_stats(entities: DataFrame, associations: DataFrame) -> DataFrame:
    e = entities.agg(F.count(F.lit(1)).alias("entities"), F.coalesce(F.sum(F.size("columns")), F.lit(0)).cast("long").alias("columns_total"), F.count_if(F.size("aliases") > 0).alias("with_aliases"), F.coalesce(F.sum("members"), F.lit(0)).alias("members"))
    return e.crossJoin(associations.agg(F.count(F.lit(1)).alias("associations")))


def model_summary(elements: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of entities, repositories, shared data, entities with columns, and edges that touch data."""
    s = lambda x: F.count_if(F.col("stereotype") == x)
    counts = elements.agg(s("Entity").alias("entities"), s("Repository").alias("repositories"), s("Shared Data").alias("shared"), F.count_if((F.col("stereotype") == "Entity") & (F.size("columns") > 0)).alias("with_columns"))
    touching = edges.where(F.col("rel_type").isin("references", "accesses_table", "writes_table", "reads_dataset", "writes_dataset"))
    return counts.crossJoin(touching.agg(F.count(F.lit(1)).alias("data_relationships")))


def widest(entities: DataFrame, top: int = 15) -> DataFrame:
    n = F.size("columns").alias("n_columns")
    return entities.select("canonical", n).orderBy(F.desc("n_columns"), F.lower("canonical")).limit(top)


# -- schema files


def ddl_tables(files: DataFrame, compat: bool = False) -> DataFrame:
    """name, columns and source of the CREATE TABLE statements in files (path, text).

    Columns are the first word of each top-level definition, constraints aside. With ``compat`` a definition list ends at
    its first closing parenthesis, as in the reference tool.
    """
    body = r"([^)]*)\)" if compat else r"((?:[^()]|\([^()]*\))*)\)"
    head = r"(?is)create\s+table\s+(?:if\s+not\s+exists\s+)?((?:[\"`]?\w+[\"`]?\.)?[\"`]?\w+[\"`]?)\s*\("
    rx = head + body
    made = files.select(F.col("path").alias("source"), F.posexplode(F.arrays_zip(F.regexp_extract_all("text", F.lit(rx), F.lit(1)).alias("n"), F.regexp_extract_all("text", F.lit(rx), F.lit(2)).alias("b"))).alias("pos", "t"))
    name = F.regexp_replace(F.element_at(F.split("t.n", r"\."), -1), "[\"`]", "")
    flat = F.col("t.b") if compat else F.regexp_replace("t.b", r"\([^()]*\)", "")
    words = F.transform(F.split(flat, r"[,\n]" if not compat else "\n"), lambda x: F.regexp_extract(x, r"^\s*[\"`]?(\w+)[\"`]?\s+\w", 1))
    skip = F.filter(words, lambda w: (w != "") & ~F.upper(w).isin("CONSTRAINT", "PRIMARY", "FOREIGN", "UNIQUE", "KEY", "INDEX", "CHECK", "REFERENCES"))
    return made.select(name.alias("name"), F.array_distinct(skip).alias("columns"), "source", "pos")


def change_log_tables(files: DataFrame) -> DataFrame:
    """Tables of createTable changes (YAML ``tableName:`` and ``name:``, or XML attributes) in files (path, text)."""
    parts = files.select(F.col("path").alias("source"), F.posexplode(F.split("text", "(?i)createTable")).alias("pos", "part")).where("pos > 0")
    name = F.regexp_extract("part", r"(?i)tableName[:=]?\s*[\"']?(\w+)", 1)
    columns = F.filter(F.regexp_extract_all("part", F.lit(r"(?i)(?:columnName|\bname)\s*[:=]\s*[\"']?(\w+)"), F.lit(1)), lambda c: ~F.lower(c).isin("tablename", "schemaname"))
    return parts.select(name.alias("name"), F.array_distinct(columns).alias("columns"), "source", "pos").where("name <> ''")


def merged_tables(tables: DataFrame) -> DataFrame:
    """One table for each name without case: the union of columns and the list of sources, in order of source."""
    t = tables.withColumn("ord", F.struct("source", "pos"))
    return t.groupBy(F.lower("name").alias("key")).agg(F.min_by("name", "ord").alias("name"), _ordered_union("columns", "ord").alias("columns"), F.array_sort(F.collect_set("source")).alias("sources"))


def schema_drift(tables: DataFrame, entities: DataFrame) -> DataFrame:
    """name, status (schema_only, model_only, columns) and the columns that only one side has."""
    a = tables.select("key", F.struct("name", "columns").alias("s"))
    b = entities.select("key", F.struct(F.col("canonical").alias("name"), "columns").alias("m"))
    both = a.join(b, "key", "full_outer")
    low = lambda c: F.transform(c, F.lower)
    compare = (F.size("s.columns") > 0) & (F.size("m.columns") > 0)
    missing = F.when(compare, F.array_sort(F.array_except(low("s.columns"), low("m.columns")))).otherwise(_no_texts())
    extra = F.when(compare, F.array_sort(F.array_except(low("m.columns"), low("s.columns")))).otherwise(_no_texts())
    status = F.when(F.col("m").isNull(), "schema_only").when(F.col("s").isNull(), "model_only").otherwise("columns")
    out = both.select(F.coalesce("s.name", "m.name").alias("name"), status.alias("status"), F.array_join(missing, ",").alias("not_in_model"), F.array_join(extra, ",").alias("not_in_schema"))
    return out.where("status <> 'columns' OR not_in_model <> '' OR not_in_schema <> ''")


# -- domains and capabilities


def domains(elements: DataFrame, min_size: int = 2) -> DataFrame:
    """name, signal, size, stereotypes and tables: by first intent domain, else container, else package."""
    intent = F.get("domains", F.lit(0)) if "domains" in elements.columns else F.lit(None).cast("string")
    token = N.package_token(F.col("file_path"), F.col("language"))
    named = elements.select("name", "stereotype", "table_name", F.coalesce(intent, "container", token).alias("domain"), F.when(intent.isNotNull(), "intent").when(F.col("container").isNotNull(), "container").otherwise("package").alias("signal"))
    count = named.groupBy("domain", "stereotype").agg(F.count(F.lit(1)).alias("n"), F.max("signal").alias("hi"), F.min("signal").alias("lo"), F.collect_set(F.when(F.col("stereotype") == "Entity", F.coalesce("table_name", "name"))).alias("t"))
    hist = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("stereotype", "n"))), lambda s: F.concat(s["stereotype"], F.lit(":"), s["n"].cast("string"))), ",")
    tables = F.array_join(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("t")))), 1, 40), ",")
    whole = count.where("domain IS NOT NULL").groupBy("domain").agg(F.sum("n").alias("size"), F.min("lo").alias("signal"), hist.alias("stereotypes"), tables.alias("tables"))
    return whole.where((F.col("size") >= min_size) | (F.col("signal") != "package")).select(F.col("domain").alias("name"), "signal", "size", "stereotypes", "tables")


def capabilities(elements: DataFrame) -> DataFrame:
    """Candidate capabilities of entry points: id, title, element, stereotype, status. Of equal ids only the first keeps the plain one."""
    e = elements.where(F.col("stereotype").isin(ENTRY)).select(N.capability_id(F.col("name")).alias("slug"), N.guess_title(F.col("name"), F.col("stereotype")).alias("title"), F.col("name").alias("element"), "stereotype", "ord")
    k = F.row_number().over(Window.partitionBy("slug").orderBy("ord"))
    return e.withColumn("k", k).select(F.when(F.col("k") == 1, F.col("slug")).otherwise(N.capability_id(F.concat_ws("-", "element", "stereotype"))).alias("id"), "title", "element", "stereotype", F.lit("proposed").alias("status"))


def merged_capabilities(existing: DataFrame, found: DataFrame) -> DataFrame:
    """The catalogue after a new discovery: human fields (title, status) of existing rows stay; rows of ``existing`` that
    match by id, else by element; those without a match are missing in code."""
    old = existing.select(F.col("id").alias("old_id"), F.col("title").alias("old_title"), F.col("element").alias("old_element"), F.col("status").alias("old_status"))
    by_id = found.join(old, found["id"] == old["old_id"], "left")
    hit, rest = by_id.where("old_id IS NOT NULL"), by_id.where("old_id IS NULL").select(*found.columns)
    free = old.join(hit.select("old_id"), "old_id", "left_anti")
    first = free.groupBy("old_element").agg(F.min_by(F.struct(*free.columns), "old_id").alias("o")).select("o.*")
    by_element = rest.join(first, rest["element"] == first["old_element"], "left")
    both = hit.unionByName(by_element.select(*hit.columns))
    kept = both.select(F.coalesce("old_id", "id").alias("id"), F.coalesce("old_title", "title").alias("title"), "element", F.coalesce("old_status", "status").alias("status"), F.lit(False).alias("missing_in_code"))
    gone = old.join(kept.select(F.col("id").alias("old_id")), "old_id", "left_anti").select(F.col("old_id").alias("id"), F.col("old_title").alias("title"), F.col("old_element").alias("element"), F.col("old_status").alias("status"), F.lit(True).alias("missing_in_code"))
    every = kept.unionByName(gone)
    order = Window.partitionBy("id").orderBy(F.when(F.col("status") == "approved", 0).otherwise(1), F.lower("title"))
    return every.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def synced(existing: DataFrame, elements: DataFrame) -> DataFrame:
    """The catalogue after a new discovery in ``elements``."""
    return merged_capabilities(existing, capabilities(elements))


def in_playbook_order(found: DataFrame, limit: int | None = None) -> DataFrame:
    """Capabilities in the order of playbooks: approved ones first, those missing in code last, then by title; k counts from 1."""
    missing = F.col("missing_in_code") if "missing_in_code" in found.columns else F.lit(False)
    by = [F.when(F.col("status") == "approved", 0).otherwise(1), missing.cast("int"), F.lower("title"), F.col("id")]
    first = found.orderBy(*by).limit(limit) if limit is not None else found
    # A catalogue is as large as the number of entry points at most, and the window only numbers what a report asks for.
    return first.withColumn("k", F.row_number().over(Window.orderBy(*by)))


def matching_capabilities(found: DataFrame, wanted: str) -> DataFrame:
    """The capabilities with this id, a title that contains it or this element, without case; rank says which (0, 1, 2)."""
    low = wanted.strip().lower()
    rank = F.when(F.lower("id") == low, 0).when(F.lower("title").contains(low), 1).when(F.lower("element") == low, 2)
    return found.withColumn("rank", rank).where("rank IS NOT NULL") if low else found.withColumn("rank", F.lit(0)).limit(0)


def match_capability(found: DataFrame, wanted: str) -> DataFrame:
    """The one capability that is meant: the first in playbook order among those that match."""
    return in_playbook_order(matching_capabilities(found, wanted).drop("rank"), 1).drop("k")


def with_tables(found: DataFrame, elements: DataFrame, edges: DataFrame) -> DataFrame:
    """Capabilities with the file of their element and the tables related to it (joined by commas)."""
    from .graph import related_tables

    own = elements.where(F.col("stereotype").isin(ENTRY)).groupBy(F.col("name").alias("element"), "stereotype").agg(F.min_by(F.struct("id", "file_path"), "ord").alias("e")).select("element", "stereotype", F.col("e.id").alias("entry_id"), "e.file_path")
    placed = found.join(own, ["element", "stereotype"], "left")
    tables = related_tables(elements, edges, placed.where("entry_id IS NOT NULL").select(F.col("entry_id").alias("id"))).select("entry_id", "tables")
    return placed.join(tables, "entry_id", "left").select(*found.columns, "file_path", F.coalesce("tables", F.lit("")).alias("related_tables"))


def unassigned(elements: DataFrame, min_size: int = 2, most: int = 100) -> DataFrame:
    """Elements in no domain, or in a package of fewer than ``min_size``: the first ``most`` by name and id."""
    intent = F.get("domains", F.lit(0)) if "domains" in elements.columns else F.lit(None).cast("string")
    token = N.package_token(F.col("file_path"), F.col("language"))
    named = elements.select("id", "name", F.coalesce(intent, "container", token).alias("domain"), (intent.isNotNull() | F.col("container").isNotNull()).alias("told"))
    size = named.where("domain IS NOT NULL").groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.max("told").alias("any"))
    small = named.join(size, "domain", "left").where(F.col("domain").isNull() | ((F.col("n") < min_size) & ~F.col("any")))
    return small.select("id", "name", "domain").orderBy("name", "id").limit(most)


def from_exports(parts: dict[str, tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Entities and associations of the canonical data model of several repositories' exports (by slug: elements, edges)."""
    from .relational import aggregated

    entities = cdm_entities(aggregated(parts)[0])
    return entities, cdm_associations(entities)


def merged_events(parts: dict[str, DataFrame]) -> DataFrame:
    """Event edges of several repositories in one table, each with its slug."""
    out = None
    for slug, events in parts.items():
        one = events.withColumn("source_slug", F.lit(slug))
        out = one if out is None else out.unionByName(one)
    return out


# -- intents


def apply_intents(elements: DataFrame, overrides: dict[str, str], owners: dict[str, str], boundaries: dict[str, tuple[list[str], list[str]]], critical: dict[str, list[str]]) -> DataFrame:
    """Elements with overridden stereotypes, owners, the boundaries their paths lie in (domains) and their critical paths."""
    by = lambda table: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col("name")] if table else F.lit(None).cast("string")
    within = [F.when((N.matches_any(F.col("file_path"), inc) if inc else F.lit(True)) & ~N.matches_any(F.col("file_path"), exc), F.lit(name)) for name, (inc, exc) in boundaries.items()]
    on = [F.when(F.col("name").isin(names), F.lit(path)) for path, names in critical.items()]
    some = lambda xs: F.filter(F.array(*xs), lambda x: x.isNotNull()) if xs else _no_texts()
    return elements.withColumns({"stereotype": F.coalesce(by(overrides), "stereotype"), "owner": by(owners), "domains": some(within), "critical_paths": some(on)})


def forbidden_edges(elements: DataFrame, edges: DataFrame, rules: DataFrame) -> DataFrame:
    """Edges that a rule (source, target, reason) forbids; selectors are names, stereotypes, containers or domains, without case."""
    marks = [F.col("name"), F.col("stereotype"), F.col("container")]
    every = F.array(*marks) if "domains" not in elements.columns else F.concat(F.array(*marks), "domains")
    tags = elements.select("id", F.explode(F.array_distinct(F.transform(F.filter(every, lambda x: x.isNotNull()), F.lower))).alias("tag"))
    r = rules.select(F.lower("source").alias("s"), F.lower("target").alias("t"), "reason")
    a = tags.join(F.broadcast(r), tags["tag"] == r["s"]).select(F.col("id").alias("source_id"), "s", "t", "reason")  # rules are written by hand: few
    hit = edges.join(a, "source_id").join(tags.select(F.col("id").alias("target_id"), F.col("tag").alias("t")), ["target_id", "t"])
    return hit.select("s", "t", "reason", "source_id", "target_id", "rel_type").distinct()


def missing_on_paths(elements: DataFrame, paths: DataFrame) -> DataFrame:
    """name and the elements of critical paths (name, elements) that don't exist."""
    wanted = paths.select(F.col("name").alias("path"), F.explode("elements").alias("name"))
    return wanted.join(elements.select("name").distinct(), "name", "left_anti").groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("missing"))


def path_edges(paths: DataFrame) -> DataFrame:
    """A composes edge between each two neighbours on a critical path (name, elements)."""
    each = paths.select(F.col("name").alias("path"), F.posexplode("elements").alias("pos", "source_name"))
    nxt = F.lead("source_name").over(Window.partitionBy("path").orderBy("pos"))
    return each.withColumn("target_name", nxt).where("target_name IS NOT NULL").select("path", "source_name", "target_name", F.lit("composes").alias("rel_type"))


# -- topics and contracts

_Q = "[\"']"


def _given(call: str, key: str) -> str:
    """The pattern of a call or annotation with a named text argument."""
    return rf"{call}\s*\((?:[^)]*?\b)?{key}\s*=\s*\{{?\s*{_Q}([^\"']+)"


#: role, technology, pattern; the first group is the topic, patterns without one tell only the technology.
ENDPOINTS = [
    ("producer", "Kafka", rf"kafkaTemplate\.send\s*\(\s*{_Q}([^\"']+)"), ("producer", "Kafka", rf"\bproducer\.send\s*\(\s*{_Q}([^\"']+)"), ("producer", "Kafka", rf"client\.emit\s*\(\s*{_Q}([^\"']+)"),
    ("consumer", "Kafka", _given("@KafkaListener", "topics")), ("consumer", "Kafka", rf"consumer\.subscribe\s*\(\s*\[\s*{_Q}([^\"']+)"), ("consumer", "Kafka", rf"@EventPattern\s*\(\s*{_Q}([^\"']+)"),
    ("producer", "Kafka", r"\bAIOKafkaProducer|(?<!AIO)KafkaProducer"), ("consumer", "Kafka", r"\bAIOKafkaConsumer|(?<!AIO)KafkaConsumer"),
    ("consumer", "RabbitMQ", _given("@RabbitListener", "queues")), ("producer", "RabbitMQ", rf"convertAndSend\s*\(\s*{_Q}([^\"']+)"), ("producer", "RabbitMQ", _given("basic_publish", "routing_key")), ("producer", "RabbitMQ", r"\baio_pika|pika\.BlockingConnection"),
    ("producer", "SQS", _given("send_message", "QueueUrl")), ("consumer", "SQS", _given("receive_message", "QueueUrl")), ("consumer", "SQS", rf"@SqsListener\s*\(\s*{_Q}([^\"']+)"), ("producer", "SQS", rf"boto3\.client\s*\(\s*{_Q}sqs"),
    ("consumer", "NATS/RMQ", rf"@MessagePattern\s*\(\s*{_Q}([^\"']+)"),
]
METHODS = "(get|post|put|patch|delete)"
_PATH = r"[`'\"]([^`'\"\s]+)[`'\"]"
#: HTTP method (null: the first group), pattern, group of the path.
CALLS = [
    ("GET", rf"(?i)\bfetch\(\s*{_PATH}", 1), (None, rf"(?i)\b(?:axios|httpx|requests)\.{METHODS}\(\s*{_PATH}", 2), ("GET", rf"\b(?:getForObject|exchange)\(\s*{_PATH}", 1), ("POST", rf"\bpostForObject\(\s*{_PATH}", 1),
    ("GET", rf"WebClient\.create\([^)]*\)\.\w+\(\)\.\w+\(\s*{_PATH}", 1), (None, rf"@(?i:{METHODS})Mapping\(\s*{_PATH}", 2),
]


def endpoints(files: DataFrame) -> DataFrame:
    """file_path, role, technology and topic of every broker endpoint in files (path, text)."""
    def told(role: str, tech: str):
        return lambda t: F.struct(F.lit(role).alias("role"), F.lit(tech).alias("technology"), t.alias("topic"))

    found = []
    for role, tech, rx in ENDPOINTS:
        if "([^" in rx:
            topics = F.regexp_extract_all("text", F.lit(f"(?i){rx}"), F.lit(1))
        else:
            topics = F.when(F.col("text").rlike(f"(?i){rx}"), F.array(F.lit(f"{tech.lower()}-unknown"))).otherwise(_no_texts())
        found.append(F.transform(topics, told(role, tech)))
    return files.select(F.col("path").alias("file_path"), F.explode(F.concat(*found)).alias("e")).select("file_path", "e.*").distinct()


def topics(ends: DataFrame) -> DataFrame:
    """producers, consumers (distinct files) and technology of each topic."""
    role = lambda r: F.count_distinct(F.when(F.col("role") == r, F.col("file_path")))
    return ends.groupBy("topic").agg(role("producer").alias("producers"), role("consumer").alias("consumers"), F.min_by("technology", F.struct("file_path", "role", "technology")).alias("technology"))


#: Producers and consumers of one topic that meet in one block of pairs.
BLOCK = (2_000, 500)


def topic_edges(ends: DataFrame) -> DataFrame:
    """publishes_to from every producing file to every other file that consumes the topic.

    Pairs grow with the square of a topic's files: large topics are cut into blocks, so no task has a topic to itself, and
    pairs of the same few files lie together, which Parquet stores in little.
    """
    p = ends.where("role = 'producer'").select("topic", F.col("file_path").alias("source_id")).distinct()
    c = ends.where("role = 'consumer'").select("topic", F.col("file_path").alias("target_id")).distinct()
    blocks = lambda df, most: df.groupBy("topic").agg(F.ceil(F.count(F.lit(1)) / most).alias("n"))
    n = blocks(p, BLOCK[0]).withColumnRenamed("n", "ps").join(blocks(c, BLOCK[1]).withColumnRenamed("n", "cs"), "topic")
    own = lambda name, most: F.pmod(F.xxhash64(name), most)
    each = lambda most: F.explode(F.sequence(F.lit(0).cast("long"), F.col(most) - 1))
    p = p.join(n, "topic").select("topic", "source_id", own("source_id", "ps").alias("a"), each("cs").alias("b"))
    c = c.join(n, "topic").select("topic", "target_id", each("ps").alias("a"), own("target_id", "cs").alias("b"))
    return p.join(c, ["topic", "a", "b"]).where("source_id <> target_id").select("source_id", "target_id", F.lit("publishes_to").alias("rel_type"), "topic")


def call_sites(files: DataFrame) -> DataFrame:
    """file_path, method, url and path of every HTTP call in files (path, text)."""
    found = []
    for method, rx, group in CALLS:
        paths = F.regexp_extract_all("text", F.lit(rx), F.lit(group))
        methods = F.array_repeat(F.lit(method), F.size(paths)) if method else F.transform(F.regexp_extract_all("text", F.lit(rx), F.lit(1)), lambda v: F.upper(v))
        found.append(F.arrays_zip(methods.alias("method"), paths.alias("url")))
    return files.select(F.col("path").alias("file_path"), F.explode(F.concat(*found)).alias("c")).select("file_path", "c.method", "c.url", N.url_path(F.col("c.url")).alias("path")).distinct()


def _yaml_as_json(specs: DataFrame) -> DataFrame:
    """Documents (service, text) in YAML as JSON; those that can't be read are left out."""
    import pyarrow as pa

    def worker(batches):
        import json

        import yaml

        for batch in batches:
            rows = []
            for service, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows.append((service, json.dumps(yaml.safe_load(text or ""), default=str)))
                except (yaml.YAMLError, ValueError, RecursionError):
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], ["service", "text"])

    return specs.mapInArrow(worker, "service string, text string")


def operations(specs: DataFrame) -> DataFrame:
    """service, method and path of every operation of OpenAPI documents in JSON or YAML (service, text); malformed ones have none."""
    json = F.ltrim(F.coalesce("text", F.lit(""))).startswith("{")
    every = specs.select("service", "text")
    every = every.where(json).unionByName(_yaml_as_json(every.where(~json)))
    paths = F.from_json("text", "struct<paths: map<string, map<string, string>>>")["paths"]
    each = every.select("service", F.explode(paths).alias("path", "ops"))
    verbs = each.select("service", "path", F.explode(F.map_keys("ops")).alias("method")).where(F.lower("method").isin([r for r in N.ROUTES if r != "api_route"]))
    return verbs.select("service", F.upper("method").alias("method"), N.url_path(F.col("path")).alias("path"))


def contract_links(calls: DataFrame, ops: DataFrame) -> DataFrame:
    """Calls (method, path ...) with the operations (method, template) they match: the join is by method and number of
    segments, the template is matched on what that leaves."""
    n = lambda c: F.size(F.split(c, "/"))
    a = calls.withColumn("segments", n("path"))
    b = ops.select("method", F.col("path").alias("template"), n("path").alias("segments"), *[c for c in ops.columns if c not in ("method", "path")])
    return a.join(b, ["method", "segments"]).where(N.paths_match(F.col("path"), F.col("template"))).drop("segments")


def report_rows(elements: DataFrame) -> DataFrame:
    """container, size and up to 12 names of each stereotype, for the report."""
    e = with_container(elements)
    return e.groupBy("container", "stereotype").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.slice(F.array_sort(F.collect_set("name")), 1, 12), ",").alias("names"))
