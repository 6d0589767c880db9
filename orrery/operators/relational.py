"""Filters, lookups, counts, resolution joins and differences over elements and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..schema import SLICE_RELS

ALIASES = {alias: stereotype.replace("_", " ") for stereotype, names in {
    "Controller": "controller controllers", "Service": "service services", "Repository": "repository repositories repo repos", "Component": "component components", "UI_Component": "ui ui_component ui_components",
    "Middleware": "middleware", "Configuration": "config configuration", "Gateway": "gateway gateways", "Entity": "entity entities", "Worker": "worker workers",
}.items() for alias in names.split()}


def listed(elements: DataFrame) -> DataFrame:
    """name, stereotype, language, file_path, id and citation (file#name)."""
    return elements.select("name", "stereotype", "language", "file_path", "id", F.concat("file_path", F.lit("#"), "name").alias("citation"))


def of_stereotype(elements: DataFrame, stereotype: str) -> DataFrame:
    return listed(elements.where(F.lower("stereotype") == stereotype.lower()))


def named(elements: DataFrame, text: str) -> DataFrame:
    """Elements of this name, or with this text in their id, without case."""
    return elements.where((F.lower("name") == text.lower()) | F.lower("id").contains(text.lower()))


def citations(elements: DataFrame, limit: int = 40) -> DataFrame:
    """One row with the first ``limit`` citations by ord."""
    first = elements.orderBy("ord").limit(limit).select("ord", F.concat("file_path", F.lit("#"), "name").alias("c"))
    return first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "c"))), lambda s: s["c"]), ";").alias("citations"))


def changed(elements: DataFrame, files: list[str], wanted: list[str]) -> DataFrame:
    """Elements of changed files (equal, or one a suffix of the other, or contained) or with a changed name or id."""
    path = F.replace("file_path", F.lit("\\"), F.lit("/"))
    hit = F.lit(False)
    for f in (f.replace("\\", "/") for f in files):
        hit = hit | path.endswith(f) | F.lit(f).endswith(path) | F.lit(f).contains(path)
    low = [w.lower() for w in wanted]
    return elements.where(hit | F.lower("name").isin(low) | F.lower("id").isin(low))


def listing(elements: DataFrame, stereotype: str | None = None, language: str | None = None, pattern: str | None = None) -> DataFrame:
    out = elements
    if stereotype:
        out = out.where(F.lower("stereotype") == stereotype.lower())
    if language:
        out = out.where(F.lower("language") == language.lower())
    if pattern:
        out = out.where(F.col("name").rlike(N.glob_pattern(pattern)))
    return out.select("id", "name", "stereotype", "language")


def counted(elements: DataFrame, *keys: str | Column) -> DataFrame:
    return elements.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def with_container(elements: DataFrame) -> DataFrame:
    return elements.withColumn("container", N.container_of(F.col("container"), F.col("file_path")))


def container_matrix(elements: DataFrame, edges: DataFrame) -> DataFrame:
    """from_container, to_container and n of the edges between different containers."""
    at = with_container(elements).select("id", "container")
    a, b = at.toDF("source_id", "from_container"), at.toDF("target_id", "to_container")
    return counted(edges.join(a, "source_id").join(b, "target_id").where("from_container <> to_container"), "from_container", "to_container")


def container_report(elements: DataFrame) -> DataFrame:
    """Counts by container and stereotype with both subtotals and the total (nulls mark sums)."""
    return with_container(elements).groupingSets([["container", "stereotype"], ["container"], ["stereotype"], []], "container", "stereotype").agg(F.count(F.lit(1)).alias("n"))


def dependency_table(elements: DataFrame, edges: DataFrame, stereotypes: list[str], top: int = 30, width: int = 8) -> DataFrame:
    """The first ``top`` elements of these stereotypes with up to ``width`` names of what they depend on."""
    first = elements.where(F.col("stereotype").isin(stereotypes)).orderBy("stereotype", "name", "id").limit(top).select("id", "name", "stereotype")
    targets = edges.join(elements.select(F.col("id").alias("target_id"), F.col("name").alias("target")), "target_id").select(F.col("source_id").alias("id"), "target")
    found = first.join(targets, "id", "left").groupBy("id", "name", "stereotype").agg(F.array_sort(F.collect_set("target")).alias("t"))
    return found.select("id", "name", "stereotype", F.array_join(F.slice("t", 1, width), ",").alias("depends_on"))


# -- resolution


def resolve_names(edges: DataFrame, elements: DataFrame) -> DataFrame:
    """Edges whose target is no id are pointed to an element of that name (the last dotted part): of several one of the
    source's language, then the least ord. Edges that stay unresolved are dropped. Adds resolved."""
    ids = elements.select(F.col("id").alias("target_id"), F.lit(True).alias("known"))
    source = elements.select(F.col("id").alias("source_id"), F.col("language").alias("source_language"))
    marked = edges.join(ids, "target_id", "left").join(source, "source_id", "left")
    direct = marked.where("known").select("source_id", "target_id", "rel_type", F.lit(False).alias("resolved"))
    open_ = marked.where("known IS NULL").withColumn("last", F.element_at(F.split("target_id", r"\."), -1))
    # One candidate for each name and language, and one for each name: edges meet at most one row of either, however
    # many elements share a name.
    by_language = elements.groupBy(F.col("name").alias("last"), F.col("language").alias("source_language")).agg(F.min(F.struct("ord", "id")).alias("own"))
    by_name = elements.groupBy(F.col("name").alias("last")).agg(F.min(F.struct("ord", "id")).alias("any"))
    best = open_.join(by_language, ["last", "source_language"], "left").join(by_name, "last")
    found = best.select("source_id", F.coalesce("own.id", "any.id").alias("target_id"), "rel_type", F.lit(True).alias("resolved"))
    return direct.unionByName(found).distinct()


def naming_edges(elements: DataFrame) -> DataFrame:
    """Controllers depend on services, and services on repositories and entities, that share their base name."""
    stripped = lambda pattern: F.lower(F.regexp_replace("name", pattern, ""))
    c = elements.where("stereotype = 'Controller'").select(F.col("id").alias("source_id"), stripped("Controller|Router|Resource").alias("base"))
    s = elements.where("stereotype = 'Service'").select("id", stripped("Service").alias("base"))
    r = elements.where("stereotype IN ('Repository', 'Entity')").select(F.col("id").alias("target_id"), stripped("Repository|Entity|Repo").alias("base"))
    one = c.join(s.withColumnRenamed("id", "target_id"), "base")
    two = s.withColumnRenamed("id", "source_id").join(r, "base")
    return one.unionByName(two).where("base <> ''").select("source_id", "target_id", F.lit("injects").alias("rel_type"), F.lit("naming convention").alias("technology")).distinct()


def interface_edges(edges: DataFrame, elements: DataFrame) -> DataFrame:
    """Who injects an interface depends on what implements it: by edge, or by name where no edge tells."""
    wants = edges.where("rel_type = 'injects'").select("source_id", F.col("target_id").alias("interface"))
    made = edges.where("rel_type = 'implements'").select(F.col("source_id").alias("target_id"), F.col("target_id").alias("interface"))
    by_edge = wants.join(made, "interface").select("source_id", "target_id")
    rest = wants.join(made, "interface", "left_anti").join(elements.select(F.col("id").alias("interface"), "name"), "interface")
    claims = elements.select(F.col("id").alias("target_id"), F.explode("implements").alias("name"))
    by_claim = rest.join(claims, "name").select("source_id", "target_id")
    return by_edge.unionByName(by_claim).where("source_id <> target_id").distinct().withColumn("rel_type", F.lit("injects"))


def fk_edges(elements: DataFrame, edges: DataFrame) -> DataFrame:
    """References from an entity to the entity whose table (else name) its key columns point to; known edges aside."""
    keys = elements.where("stereotype = 'Entity'").select(F.col("id").alias("source_id"), F.explode("fk_columns").alias("fk")).withColumn("wanted", F.lower(N.fk_target(F.col("fk"))))
    entity = elements.where("stereotype = 'Entity'")
    by_table = entity.where("table_name IS NOT NULL").groupBy(F.lower("table_name").alias("wanted")).agg(F.min_by("id", "ord").alias("t1"))
    by_name = entity.groupBy(F.lower("name").alias("wanted")).agg(F.min_by("id", "ord").alias("t2"))
    found = keys.join(by_table, "wanted", "left").join(by_name, "wanted", "left").select("source_id", F.coalesce("t1", "t2").alias("target_id"), "fk").where("target_id IS NOT NULL AND source_id <> target_id")
    return found.join(edges.select("source_id", "target_id"), ["source_id", "target_id"], "left_anti").select("source_id", "target_id", F.lit("references").alias("rel_type"), "fk").distinct()


def host_pass(elements: DataFrame, edges: DataFrame) -> DataFrame:
    """Mainframe elements with what resolved edges add: linked programs are services, executed ones batch jobs.

    Only elements that are Component, Batch Job, Service or Repository are judged anew, by their traits and edges; without
    traits the column ``traits`` may be missing.
    """
    linked = edges.where("rel_type IN ('cics_link', 'cics_xctl', 'cics_start')").select(F.col("target_id").alias("id"), F.lit(True).alias("linked_"))
    executed = edges.where("rel_type = 'executes'").select(F.col("target_id").alias("id"), F.lit(True).alias("executed_"))
    marks = linked.unionByName(executed, allowMissingColumns=True).groupBy("id").agg(F.coalesce(F.max("linked_"), F.lit(False)).alias("linked_"), F.coalesce(F.max("executed_"), F.lit(False)).alias("executed_"))
    trait = lambda t: F.coalesce(F.array_contains("traits", t), F.lit(False)) if "traits" in elements.columns else F.lit(False)
    kind = lambda *ks: F.coalesce(F.col("kind").isin(*ks), F.lit(False))
    flags = {"copybook": trait("copybook") | kind("copybook", "dclgen"), "maps": trait("maps"), "queue": trait("queue"), "data": trait("data"), "linked": F.coalesce("linked_", F.lit(False)), "executed": F.coalesce("executed_", F.lit(False)), "job": kind("jcl_job", "jcl_step")}
    judged = F.col("language").isin("cobol", "jcl") & F.col("stereotype").isin("Component", "Batch Job", "Service", "Repository") & kind("program", "program_ref", "copybook", "dclgen", "jcl_job", "jcl_step")
    again = F.when(judged, N.host_stereotype(flags)).otherwise(F.col("stereotype"))
    return elements.join(marks.hint("merge"), "id", "left").withColumn("stereotype", again).select(*elements.columns)


#: What an element is, and what only its richest row says.
_OWN = ["id", "name", "kind", "stereotype", "language", "file_path", "path", "line_start", "c4_level", "ord", "what", "container"]


def merged(elements: DataFrame, richness: Column) -> DataFrame:
    """One row for each id: the richest, of equals the first by ord, with what the others add.

    Lists are joined in that order without repeats; other details that the richest row lacks (null or empty) are those of
    the first row that has them. No group's rows are gathered: only lists with entries are.
    """
    own = [c for c in elements.columns if c in _OWN and c not in ("id", "ord")]
    rest = [c for c in elements.columns if c not in _OWN]
    lists = [c for c in rest if elements.schema[c].dataType.typeName() == "array"]
    plain = [c for c in rest if c not in lists]
    place = elements.withColumn("rank_", -richness.cast("double"))
    some = lambda c: F.col(c).isNotNull() & (F.col(c) != "") if elements.schema[c].dataType.typeName() == "string" else F.col(c).isNotNull()
    whole = place.groupBy("id").agg(
        F.min(F.struct("rank_", "ord", *own, *rest)).alias("best"), *(F.min(F.when(some(c), F.struct("rank_", "ord", c))).alias(f"first_{c}") for c in plain),
        *(F.array_sort(F.collect_set(F.when(F.size(c) > 0, F.struct("rank_", "ord", c)))).alias(f"all_{c}") for c in lists),
    )

    def detail(c: str) -> Column:
        if c in lists:
            return F.when(F.size(f"all_{c}") < 2, F.coalesce(F.get(F.transform(f"all_{c}", lambda r: r[c]), F.lit(0)), f"best.{c}")).otherwise(F.array_distinct(F.flatten(F.transform(f"all_{c}", lambda r: r[c]))))
        return F.coalesce(f"first_{c}.{c}", f"best.{c}") if c in plain else F.col(f"best.{c}") if c != "id" else F.col("id")

    return whole.select(*(detail(c).alias(c) for c in elements.columns))


# -- differences


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """id, name, change_type (added, removed, modified), stereotype and diff_summary of all changes between two snapshots."""
    fields = ["stereotype", "file_path", *[c for c in ("annotations", "extends") if c in old.columns and c in new.columns]]
    a = old.select("id", F.struct("name", *fields).alias("a"))
    b = new.select("id", F.struct("name", *fields).alias("b"))
    both = a.join(b, "id", "full_outer")
    move = lambda f, label: F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.concat(F.lit(label), F.coalesce(F.col(f"a.{f}"), F.lit("none")), F.lit(" => "), F.coalesce(F.col(f"b.{f}"), F.lit("none"))))
    parts = [move("stereotype", "stereotype "), move("file_path", "moved ")]
    if "annotations" in fields:
        flat = lambda x: F.array_sort(F.array_distinct(F.coalesce(f"{x}.annotations", F.array().cast("array<string>"))))
        parts.append(F.when(flat("a") != flat("b"), "annotations"))
    if "extends" in fields:
        parts.append(move("extends", "extends "))
    kept = F.col("a").isNotNull() & F.col("b").isNotNull()
    summary = F.when(kept, F.concat_ws("; ", *parts)).otherwise("")
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("modified")
    return both.withColumn("diff_summary", summary).where(~kept | (F.col("diff_summary") != "")).select("id", F.coalesce("b.name", "a.name").alias("name"), kind.alias("change_type"), F.coalesce("b.stereotype", "a.stereotype").alias("stereotype"), "diff_summary")


def edge_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges by (source, target, type) that came (added) or went (removed): each side is read once and meets in one aggregation."""
    key = ["source_id", "target_id", "rel_type"]
    both = old.select(*key, F.lit(1).alias("side")).unionByName(new.select(*key, F.lit(2).alias("side")))
    sides = both.groupBy(*key).agg(F.bit_or("side").alias("sides")).where("sides < 3")
    return sides.select(*key, F.when(F.col("sides") == 2, "added").otherwise("removed").alias("change_type"))


def difference_summary(changes: DataFrame) -> DataFrame:
    n = lambda k: F.count_if(F.col("change_type") == k).alias(k)
    return changes.agg(n("added"), n("removed"), n("modified"), (F.count(F.lit(1)) > 0).alias("has_changes"))


def headlines(changes: DataFrame, top: int = 3) -> DataFrame:
    """The ``top`` stereotypes of each kind of change."""
    n = counted(changes, "change_type", "stereotype")
    rank = F.row_number().over(Window.partitionBy("change_type").orderBy(F.desc("n"), "stereotype"))
    return n.withColumn("rank", rank).where(F.col("rank") <= top)


def aggregated(parts: dict[str, tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Elements and edges of several repositories in one: ids become slug::id, the slug is the default container."""
    es, rs = None, None
    for slug, (e, r) in parts.items():
        at = lambda c, s=slug: F.concat(F.lit(f"{s}::"), c)
        level = F.when(F.col("c4_level") == "Component", "Container").otherwise(F.col("c4_level"))
        e = e.withColumns({"id": at("id"), "source_slug": F.lit(slug), "container": F.coalesce("container", F.lit(slug)), "c4_level": level})
        r = r.withColumns({"source_id": at("source_id"), "target_id": at("target_id")})
        es, rs = (e, r) if es is None else (es.unionByName(e), rs.unionByName(r))
    return es, rs


def diagram_edges(elements: DataFrame, edges: DataFrame, rank: Column, max_edges: int = 400) -> DataFrame:
    """The ``max_edges`` edges (all if 0) of the highest score: twice the greater rank of the ends plus the smaller."""
    r = elements.select("id", rank.alias("p"))
    scored = edges.join(r.toDF("source_id", "a"), "source_id").join(r.toDF("target_id", "b"), "target_id").select("source_id", "target_id", "rel_type", (2 * F.greatest("a", "b") + F.least("a", "b")).alias("score"))
    ordered = scored.orderBy(F.desc("score"), F.desc("source_id"), F.desc("target_id"), "rel_type")
    return ordered.limit(max_edges) if max_edges > 0 else scored


def slice_edges(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("rel_type").isin(SLICE_RELS))
