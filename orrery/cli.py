"""Command line: scan a source tree into a store, and ask the store.

``python -m orrery.cli scan ROOT STORE``, then one of these with STORE: ``report``, ``health``, ``query``, ``impact``, ``diff``,
``domains``, ``capabilities``, ``traces``, ``cdm``, ``diagram``, ``priority``, ``strangler``, ``playbook``, ``explain``, ``onboard``,
``export``, ``list``, ``timeline``, ``drift``, ``data-model``, ``grain``, ``ops`` and ``intents``. With STORE and ROOT, whose sources
they read: ``events``, ``contracts``, ``rules`` and ``schema-drift``. ``aggregate STORE STORE ...`` asks several stores at once,
``federate URL STORE`` stores a remote snapshot, and ``init ROOT`` writes settings to start from. ``diff``, ``timeline``, ``drift``,
``schema-drift`` and ``intents`` give exit code 2 with ``--gate`` if there is something to tell. ``--ref`` takes another snapshot
than the latest, by id or commit.
"""

from __future__ import annotations

import argparse
import hashlib
import subprocess
import sys
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import federation, overlays, render, settings
from . import query as questions
from .operators import graph as G
from .operators import model as M
from .operators import relational as R
from .session import importable, session
from .settings import Settings
from .sources import extract, files, store


def git(root: str, *args: str) -> str | None:
    """What git says of a folder; None where it says nothing."""
    try:
        return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=20, check=True).stdout.strip() or None
    except (OSError, subprocess.SubprocessError):
        return None


def snapshot(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Elements and resolved relationships of a source tree, conventions, interfaces and key columns included; its settings hold."""
    own = Settings.load(root)
    tree = files.source_tree(spark, root, include or own.include or None, [*(exclude or []), *own.exclude]).where(F.col("language").isin(own.languages))
    both = extract.parsed(tree, spread=0, transactions=own.transactions).persist()
    elements = extract.elements_of(both, own)
    elements = elements.withColumn("container", F.coalesce("container", F.get(F.split("file_path", "/"), F.lit(0))))
    edges = R.resolve_names(extract.edges_of(both), elements).drop("resolved")
    shape = ["source_id", "target_id", "rel_type"]
    more = [R.naming_edges(elements).select(*shape), R.interface_edges(edges, elements).select(*shape), R.fk_edges(elements, edges).select(*shape)]
    for m in more:
        edges = edges.unionByName(m)
    elements = R.host_pass(elements, edges)
    override = own.host_override(F.col("name"))  # settings have the last word
    elements = elements.withColumn("stereotype", F.when(F.col("language") == "cobol", F.coalesce(override, "stereotype")).otherwise(F.col("stereotype")))
    return elements.withColumn("ord", F.xxhash64("file_path", "line_start", "id")), G.valid_edges(edges, elements)


def scan(spark: SparkSession, root: str, where: str, include: list[str] | None = None, exclude: list[str] | None = None) -> str:
    elements, edges = snapshot(spark, root, include, exclude)
    now = datetime.now(timezone.utc)
    commit = git(root, "rev-parse", "HEAD") or "unknown"
    name = hashlib.sha256(f"{root}{commit}{now}".encode()).hexdigest()[:12]
    head = spark.createDataFrame([(commit, now, git(root, "rev-parse", "--abbrev-ref", "HEAD"), root)], "commit_sha string, ts timestamp, branch string, repo_path string")
    return store.save(where, name, snapshots=head, elements=elements, relationships=edges)


def load(spark: SparkSession, where: str, ref: str | None = None, skip: int = 0) -> tuple[DataFrame, DataFrame]:
    """Elements and relationships of a snapshot: by id or commit, else the latest but ``skip``."""
    heads = store.read(spark, where, "snapshots")
    row = (store.find(heads, ref) if ref else store.latest_first(heads, skip + 1)).collect()
    if len(row) <= (0 if ref else skip):
        raise SystemExit("no such snapshot")
    name = row[-1]["snapshot_id"]
    return store.read(spark, where, "elements", name), store.read(spark, where, "relationships", name)


def intents(root: str) -> tuple[dict, dict, dict, dict, list]:
    """What ``.orrery/intents.yaml`` says: overrides, owners, boundaries, critical paths and forbidden edges."""
    told = overlays.load_yaml(root, ".orrery/intents.yaml", ".orrery/intents.yml")
    bounds = {k: (v.get("include") or [], v.get("exclude") or []) for k, v in (told.get("boundaries") or {}).items()}
    return told.get("overrides") or {}, told.get("owners") or {}, bounds, told.get("critical_paths") or {}, told.get("forbidden") or []


def violations(spark: SparkSession, e: DataFrame, r: DataFrame, root: str) -> DataFrame:
    """source, target and rel_type of edges that the intents forbid, and the names that critical paths miss."""
    _, _, _, critical, forbidden = intents(root)
    rules = spark.createDataFrame([(x["from"], x["to"]) for x in forbidden], "source string, target string")
    named = r.join(e.select(F.col("id").alias("source_id"), F.col("name").alias("source")), "source_id").join(e.select(F.col("id").alias("target_id"), F.col("name").alias("target")), "target_id")
    bad = named.join(rules, ["source", "target"]).select(F.lit("forbidden").alias("what"), "source", "target")
    paths = spark.createDataFrame([(k, n) for k, names in critical.items() for n in names], "source string, target string")
    return bad.unionByName(paths.join(e.select(F.col("name").alias("target")), "target", "left_anti").select(F.lit("missing").alias("what"), "source", "target"))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="orrery", description=__doc__)
    p.add_argument("command", choices="scan list report health query impact diff timeline domains capabilities traces cdm diagram priority strangler playbook explain onboard export init drift aggregate events contracts data-model grain rules ops schema-drift intents federate".split())
    p.add_argument("paths", nargs="+", help="ROOT STORE for scan, else STORE")
    p.add_argument("--name", action="append", default=[], help="element or question")
    p.add_argument("--file", action="append", default=[])
    p.add_argument("--exclude", action="append", default=[])
    p.add_argument("--depth", type=int, default=5)
    p.add_argument("--level", default="component")
    p.add_argument("--out", default="export")
    p.add_argument("--ref", help="snapshot id or commit")
    p.add_argument("--gate", action="store_true")
    a = p.parse_args(argv)
    if a.command == "init":
        print("written" if settings.initial(a.paths[0]) else "there are settings already")
        return 0
    spark = importable(session())
    if a.command == "federate":
        elements, edges = federation.remote_snapshot(spark, a.paths[0])
        name = hashlib.sha256(f"{a.paths[0]}{datetime.now(timezone.utc)}".encode()).hexdigest()[:12]
        head = spark.createDataFrame([("remote", datetime.now(timezone.utc), None, a.paths[0])], "commit_sha string, ts timestamp, branch string, repo_path string")
        print(store.save(a.paths[1], name, snapshots=head, elements=elements, relationships=edges))
        return 0
    if a.command == "aggregate":
        parts = {path.rstrip("/").rsplit("/", 1)[-1]: load(spark, path) for path in a.paths}
        e, r = R.aggregated({slug: (x.withColumn("container", F.coalesce("container", F.lit(slug))), y) for slug, (x, y) in parts.items()})
        print(render.section("Repositories", R.counted(e, "source_slug").orderBy("source_slug")) + render.section("Stereotypes", R.counted(e, "source_slug", "stereotype").orderBy("source_slug", "stereotype")) + render.section("Edges", R.counted(r, "rel_type").orderBy("rel_type")))
        return 0
    if a.command == "scan":
        print(scan(spark, a.paths[0], a.paths[1], exclude=a.exclude))
        return 0
    where = a.paths[0]
    if a.command == "list":
        print(render.markdown(store.latest_first(store.read(spark, where, "snapshots"), 20)))
        return 0
    e, r = load(spark, where, a.ref)
    tree = (lambda endings=None: files.source_tree(spark, a.paths[1], exclude=a.exclude, endings=endings))
    seeds = (lambda: R.changed(e, a.file, a.name).select("id"))
    gated = {
        "drift": lambda: R.difference(load(spark, where, skip=1)[0], e).where("change_type <> 'modified'"), "schema-drift": lambda: M.schema_drift(M.merged_tables(M.ddl_tables(tree(["sql", "ddl"]))), M.cdm_entities(e)),
        "intents": lambda: violations(spark, e, r, a.paths[1] if len(a.paths) > 1 else "."),
    }
    if a.command in gated:
        told = gated[a.command]().persist()
        print(render.section(a.command.capitalize(), told, 200))
        return 2 if a.gate and not told.isEmpty() else 0
    if a.command in ("diff", "timeline"):
        changes = R.difference(load(spark, where, skip=1)[0], e)
        print(render.timeline(changes))
        return 2 if a.gate and not changes.isEmpty() else 0
    if a.command == "export":
        store.export_json(e, r, a.out)
        return 0
    text = {
        "report": lambda: render.architecture(e, r), "health": lambda: render.section("Health", G.health(e, r)), "query": lambda: render.markdown(questions.ask(e, r, " ".join(a.name))), "domains": lambda: render.section("Domains", M.domains(e)),
        "impact": lambda: render.impact_report(x := G.impact(e, r, seeds(), a.depth), G.suggestions(x, e.join(seeds(), "id", "left_semi"))), "capabilities": lambda: render.section("Capabilities", M.capabilities(e)), "traces": lambda: render.section("Traces", G.traces(e, r), 200),
        "cdm": lambda: render.er_diagram(c := M.cdm_entities(e), M.cdm_associations(c)), "diagram": lambda: render.mermaid(e, r, a.level), "priority": lambda: render.section("Hotspots", G.hotspots(e, r)) + render.section("Unreachable", G.unreachable(e, r), 25),
        "strangler": lambda: render.section("Slice", G.strangler(e, r, seeds()), 80), "playbook": lambda: render.section("Playbook", overlays.playbook(e, r, seeds()), 400), "explain": lambda: overlays.explain(overlays.playbook(e, r, seeds()), ", ".join(a.name) or "Change"), "onboard": lambda: overlays.onboarding(e, r),
        "events": lambda: render.section("Topics", M.topics(M.endpoints(tree())), 100), "contracts": lambda: render.section("Contracts", M.contract_links(M.call_sites(tree()), M.operations(files.specs(tree(["json", "yaml", "yml"])).select(F.get(F.split("path", "/"), F.lit(0)).alias("service"), "text"))), 100),
        "data-model": lambda: render.section("Entities", M.cdm_entities(e).select("canonical", "name", F.size("columns").alias("columns"), "members").orderBy("canonical"), 80), "grain": lambda: render.section("Fine grain", overlays.fine_grain(e, r, seeds()), 200),
        "rules": lambda: render.section("Notes and rules", overlays.harvest(e.join(seeds(), "id", "left_semi") if a.name or a.file else e, tree())), "ops": lambda: render.section("Operations", overlays.operations_overlay(e)) + render.section("Programs", overlays.step_programs(e, r), 100),
    }
    print(text[a.command]())
    return 0


if __name__ == "__main__":
    sys.exit(main())
