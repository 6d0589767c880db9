"""Composed analyses: harvest of comments and rules, operations overlay, fine grain, playbooks, onboarding."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import render
from .functions import names as N
from .functions import text as T
from .operators import graph as G
from .operators import relational as R
from .schema import ENTRY


def load_yaml(folder: str, *names: str) -> dict:
    """The first of the files that exists, as a mapping; an empty one if none does."""
    import yaml

    for name in names:
        path = Path(folder, name)
        if path.is_file():
            return yaml.safe_load(path.read_text()) or {}
    return {}


def save_yaml(path: str, data: dict, overwrite: bool = True) -> bool:
    """Write a mapping; without ``overwrite`` an existing file stays. Whether it was written."""
    import yaml

    target = Path(path)
    if target.exists() and not overwrite:
        return False
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(yaml.safe_dump(data, sort_keys=False, allow_unicode=True))
    return True


CATALOGUE = (".orrery/capabilities.yaml", ".orrery/capabilities.yml")


def catalogue(df: DataFrame, most: int = 10_000) -> dict:
    """Capabilities as the mapping that is kept in YAML, the first ``most`` by id: a file for people to read and edit."""
    return {"capabilities": [r.asDict() for r in df.orderBy("id").limit(most).collect()]}


def resolved_catalogue(spark: SparkSession, folder: str, elements: DataFrame) -> DataFrame:
    """The catalogue that a folder keeps; where it keeps none, what is found in the elements. Nothing is written."""
    from .operators import model as M

    rows = load_yaml(folder, *CATALOGUE).get("capabilities") or []
    if not rows:
        return M.capabilities(elements).withColumn("missing_in_code", F.lit(False))
    names = ["id", "title", "element", "stereotype", "status"]
    given = [(*(r.get(n) for n in names), bool(r.get("missing_in_code"))) for r in rows]
    return spark.createDataFrame(given, ", ".join(f"{n} string" for n in names) + ", missing_in_code boolean")


def sync_catalogue(spark: SparkSession, folder: str, elements: DataFrame, persist: bool = True) -> DataFrame:
    """The folder's catalogue after a new discovery: titles and states that people gave stay; written unless not to ``persist``."""
    from .operators import model as M

    out = M.synced(resolved_catalogue(spark, folder, elements), elements)
    if persist:
        save_yaml(str(Path(folder, CATALOGUE[0])), catalogue(out))
    return out


def harvest(elements: DataFrame, files: DataFrame, max_comments: int = 12, max_rules: int = 20) -> DataFrame:
    """file_path, section (comment, rule) and text from the files (path, language, text) of elements; one of equal beginnings (80 characters)."""
    own = files.join(elements.select(F.col("file_path").alias("path")).distinct(), "path", "left_semi")
    comments = F.when(F.col("language") == "cobol", T.remarks(F.col("text"))).otherwise(T.doc_comments(F.col("text")))
    found = own.select("path", F.explode(F.array(F.struct(F.lit("comment").alias("section"), comments.alias("t")), F.struct(F.lit("rule").alias("section"), T.candidate_rules(F.col("text"), F.col("language")).alias("t")))).alias("s"))
    each = found.select(F.col("path").alias("file_path"), "s.section", F.posexplode("s.t").alias("pos", "text"))
    first = each.groupBy("section", F.substring("text", 1, 80).alias("head")).agg(F.min(F.struct("file_path", "pos", "text")).alias("f"))
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("section").orderBy("f"))
    ranked = first.withColumn("k", k).where(F.col("k") <= F.when(F.col("section") == "comment", max_comments).otherwise(max_rules))
    return ranked.select("f.file_path", "section", "f.text")


def operations_overlay(elements: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """section (job, step, map) and name of what operations run, in order of ord, each section capped."""
    caps = caps or {"job": 20, "step": 30, "map": 20}
    kind = F.when(F.col("kind") == "jcl_job", "job").when(F.col("kind") == "jcl_step", "step").when((F.col("kind") == "bms_map"), "map").when(F.col("stereotype") == "Batch Job", "job")
    from pyspark.sql import Window

    named = elements.select(kind.alias("section"), "name", "ord").where("section IS NOT NULL").groupBy("section", "name").agg(F.min("ord").alias("ord"))
    k = F.row_number().over(Window.partitionBy("section").orderBy("ord", "name"))
    most = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])[F.col("section")]
    return named.withColumn("k", k).where(F.col("k") <= most).select("section", "name", "k")


def fine_grain(elements: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """section (paragraph, perform, field, copy), source and target inside and around the seed programs (id)."""
    program = F.regexp_replace("source_id", r"\.(para|field)\..*$", "")  # an edge belongs to the program that its source lies in
    e = edges.withColumn("seed", program).join(seeds.select(F.col("id").alias("seed")), "seed", "left_semi")
    section = F.when((F.col("rel_type") == "composes") & F.col("target_id").contains(".para."), "paragraph").when(F.col("rel_type") == "performs", "perform").when(F.col("target_id").contains(".field."), "field").when(F.col("rel_type") == "copies", "copy")
    return e.select(section.alias("section"), "source_id", "target_id").where("section IS NOT NULL AND target_id IS NOT NULL").distinct()


def tests_of(elements: DataFrame, files: DataFrame, names: DataFrame, limit: int = 12) -> DataFrame:
    """Test files (path, text) whose words or whose own name, its test marks aside, are the elements' (name) or their bases."""
    wanted = names.select(F.explode(F.array("name", N.base_name(F.col("name")))).alias("word")).distinct()
    tests = files.where(N.is_test_path(F.col("path")))
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]*?)(\.[A-Za-z]+)*$", 1), r"^[Tt]est_?|(\.(test|spec)|_?[Tt]ests?|_?[Ss]pec)$", "")
    words = F.array_distinct(F.array_append(F.regexp_extract_all("text", F.lit(r"(\w{3,})"), F.lit(1)), stem))
    return tests.select("path", F.explode(words).alias("word")).join(wanted, "word", "left_semi").select("path").distinct().orderBy("path").limit(limit)


def cautions(elements: DataFrame, affected: DataFrame, seeds: DataFrame) -> DataFrame:
    """What not to forget about the seeds (id): high-risk dependants, entry points, batch jobs, else a default."""
    own = elements.join(seeds, "id", "left_semi")
    high = affected.where("risk = 'HIGH' AND hops = 1").orderBy("name").limit(5).select(F.concat(F.lit("High-risk dependant: "), "name").alias("note"))
    entry = own.where(F.col("stereotype").isin(ENTRY)).select(F.concat(F.lit("Entry point, mind its callers: "), "name").alias("note"))
    batch = own.where("stereotype = 'Batch Job'").select(F.concat(F.lit("Runs in batch, mind its schedule: "), "name").alias("note"))
    notes = high.union(entry).union(batch).distinct()
    default = notes.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("Nothing out of the ordinary is known").alias("note"))
    return notes.union(default)


def _tagged(df: DataFrame, section: str, text: Column, *order: str) -> DataFrame:
    return df.select(F.lit(section).alias("section"), text.cast("string").alias("text"), *(F.lit(0).alias("ord") for _ in [0] if not order), *(F.col(o).cast("int").alias("ord") for o in order[:1]))


def playbook(elements: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 4) -> DataFrame:
    """section, ord and text: reading path, impact, slice, tables and cautions for changing the seeds (id)."""
    affected = G.impact(elements, edges, seeds, depth)
    parts = [
        _tagged(G.reading_path(elements, edges, seeds), "read", F.concat("name", F.lit(" ("), "file_path", F.lit(")")), "step"), _tagged(affected, "affected", F.concat("name", F.lit(": "), "reason"), "hops"),
        _tagged(G.strangler(elements, edges, seeds), "slice", F.concat("part", F.lit(": "), "name"), "hops"), _tagged(G.related_tables(elements, edges, seeds), "tables", F.col("tables")), _tagged(cautions(elements, affected, seeds), "caution", F.col("note")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("section", "ord", "text")


def enriched(book: DataFrame, elements: DataFrame, edges: DataFrame, seeds: DataFrame, files: DataFrame, depth: int = 4) -> DataFrame:
    """A playbook with what source files (path, language, text) add: tests, hints, comments, candidate rules and operations."""
    own = elements.join(seeds, "id", "left_semi")
    affected = G.impact(elements, edges, seeds, depth)
    near = elements.join(affected.select("id").union(seeds.select("id")).distinct(), "id", "left_semi")
    notes, runs = harvest(own, files), operations_overlay(near)
    parts = [
        _tagged(tests_of(elements, files, own), "tests", F.col("path")), _tagged(G.suggestions(affected, own), "hints", F.col("text"), "ord"), _tagged(G.surroundings(affected, own, elements), "hints", F.col("text"), "ord"),
        _tagged(notes, "notes", F.concat("section", F.lit(": "), "text")), _tagged(runs, "operations", F.concat("section", F.lit(": "), "name"), "k"),
    ]
    for p in parts:
        book = book.unionByName(p.select("section", "ord", "text"))
    return book


def step_programs(elements: DataFrame, edges: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """What operations run: section (step, transaction), name and the program that it executes or starts.

    ``texts`` (text) are resource definitions that name the programs of transactions.
    """
    steps = edges.where("rel_type = 'executes'").join(elements.where("kind = 'jcl_step'").select(F.col("id").alias("source_id"), "name"), "source_id")
    program = F.regexp_replace("target_id", r"^cobol\.", "")
    out = steps.select(F.lit("step").alias("section"), F.col("source_id").alias("name"), program.alias("program"))
    if texts is not None:
        told = texts.select(F.explode(T.transactions(F.col("text"))).alias("t")).select("t.*")
        out = out.unionByName(told.select(F.lit("transaction").alias("section"), F.col("transaction").alias("name"), "program"))
    return out.distinct()


def explain(book: DataFrame, title: str) -> str:
    """A narrative made of a playbook's lines only."""
    rows = book.orderBy("section", "ord", "text").limit(400).collect()
    by: dict[str, list[str]] = {}
    for r in rows:
        by.setdefault(r["section"], []).append(r["text"])
    lead = {"read": "Start reading at", "affected": "A change reaches", "slice": "It can be moved out with", "tables": "It touches the tables", "caution": "Mind", "tests": "These tests cover it", "hints": "Before a change", "notes": "Its sources say", "operations": "Operations run it by"}
    return f"# {title}\n\n" + "\n\n".join(f"{lead[s]}: {'; '.join(xs[:8])}." for s, xs in by.items())


def onboarding(elements: DataFrame, edges: DataFrame) -> str:
    """A first guide: what there is, where it begins, what matters most."""
    return "\n".join(
        ["# Getting started\n", render.section("What there is", R.counted(elements, "stereotype").orderBy(F.desc("n"), "stereotype")), render.section("Where it begins", elements.where(F.col("stereotype").isin(ENTRY)).orderBy("ord").select("name", "stereotype", "file_path"), 12), render.section("What matters", G.hotspots(elements, edges)), render.section("What nothing leads to", G.unreachable(elements, edges).orderBy("id"), 25)]
    )
