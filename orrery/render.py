"""Text reports and diagrams: small results are collected, by design bounded, and formatted on the driver."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import graph as G
from .operators import model as M
from .operators import relational as R
from .schema import WEIGHT, lookup


def safe(name: str) -> str:
    flat = re.sub(r"[^A-Za-z0-9_]", "_", name)
    return f"n_{flat}" if not flat or flat[0].isdigit() else flat


def markdown(df: DataFrame, limit: int = 50) -> str:
    """A DataFrame's first rows as a Markdown table."""
    rows = df.limit(limit).collect()
    cell = lambda v: "" if v is None else ", ".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v).replace("|", "\\|").replace("\n", " ")
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])


def section(title: str, df: DataFrame, limit: int = 50) -> str:
    return f"## {title}\n\n{markdown(df, limit)}\n"


def mermaid(elements: DataFrame, edges: DataFrame, level: str = "component", highlight: set[str] = frozenset(), max_edges: int = 400) -> str:
    """A flow chart of components (the best edges), of containers (counts) or of the whole system."""
    if level == "container":
        rows = R.container_matrix(elements, edges).orderBy(F.desc("n"), "from_container", "to_container").limit(max_edges or 400).collect()
        return "\n".join(["graph LR", *(f"  {safe(r[0])}[{r[0]}] -->|{r[2]}| {safe(r[1])}[{r[1]}]" for r in rows)])
    if level == "context":
        n = R.counted(elements, "stereotype").orderBy("stereotype").collect()
        return "\n".join(["graph TD", "  system[System]", *(f"  system --> {safe(r[0])}[{r[0]}: {r[1]}]" for r in n)])
    best = R.diagram_edges(elements.where("c4_level <> 'Code'"), edges, lookup("stereotype", WEIGHT, 1.0), max_edges)
    names = elements.select("id", "name")
    rows = best.join(names.toDF("source_id", "a"), "source_id").join(names.toDF("target_id", "b"), "target_id").orderBy(F.desc("score"), "source_id", "target_id").limit(max_edges or 400).collect()
    lines = [f"  {safe(r['source_id'])}[\"{r['a']}\"] -->|{r['rel_type']}| {safe(r['target_id'])}[\"{r['b']}\"]" for r in rows]
    marks = [f"  style {safe(h)} stroke-width:4px" for h in sorted(highlight)]
    return "\n".join(["graph TD", *lines, *marks])


def structurizr(elements: DataFrame, edges: DataFrame, name: str = "System", max_elements: int = 400) -> str:
    rows = R.with_container(elements.where("c4_level <> 'Code'")).orderBy("ord").limit(max_elements).collect()
    known = {r["id"] for r in rows}
    kept = edges.where(F.col("source_id").isin(list(known)) & F.col("target_id").isin(list(known))).orderBy("source_id", "target_id", "rel_type").limit(4 * max_elements).collect()
    out = ["workspace {", "  model {", f'    system = softwareSystem "{name}" {{']
    for c in sorted({r["container"] or "main" for r in rows}):
        out += [f'      {safe(c)} = container "{c}" {{', *(f'        {safe(r["id"])} = component "{r["name"]}" "{r["stereotype"]}"' for r in rows if (r["container"] or "main") == c), "      }"]
    out += ["    }", *(f'    {safe(e["source_id"])} -> {safe(e["target_id"])} "{e["rel_type"]}"' for e in kept), "  }", "}"]
    return "\n".join(out)


def er_diagram(entities: DataFrame, associations: DataFrame, most: int = 40, columns: int = 8) -> str:
    """Connected tables first, then the widest, with their first columns."""
    ends = associations.select(F.col("source").alias("canonical")).union(associations.select("target")).distinct().withColumn("linked", F.lit(1))
    top = entities.join(ends, "canonical", "left").orderBy(F.col("linked").isNull(), F.desc(F.size("columns")), F.lower("canonical")).limit(most).select("canonical", F.slice("columns", 1, columns).alias("columns")).collect()
    known = {r["canonical"] for r in top}
    out = ["erDiagram"]
    for r in top:
        out += [f"  {safe(r['canonical'])} {{", *(f"    {'int' if c.upper().endswith('_ID') else 'string'} {safe(c)}" for c in r["columns"]), "  }"]
    out += [f"  {safe(a['source'])} }}o--|| {safe(a['target'])} : {safe(a['fk'])}" for a in associations.orderBy("source", "target", "fk").limit(400).collect() if a["source"] in known and a["target"] in known]
    return "\n".join(out)


def architecture(elements: DataFrame, edges: DataFrame, title: str = "Architecture") -> str:
    """The whole report: overview, containers, entry points, data model, capabilities, health and diagram."""
    entities = M.cdm_entities(elements)
    associations = M.cdm_associations(entities)
    return "\n".join(
        [
            f"# {title}\n", section("Elements by stereotype", R.counted(elements, "stereotype").orderBy(F.desc("n"), "stereotype")), section("Containers", M.report_rows(elements).orderBy("container", "stereotype")),
            section("Between containers", R.container_matrix(elements, edges).orderBy(F.desc("n"), "from_container", "to_container"), 10), section("Hotspots", G.hotspots(elements, edges)),
            section("Dependencies", R.dependency_table(elements, edges, ["Controller", "Gateway", "Service", "Repository", "Worker", "Batch Job", "Middleware", "Configuration", "UI Component"])),
            section("Data model", M.cdm_stats(entities, associations)), section("Widest tables", M.widest(entities)), section("Capabilities", M.capabilities(elements).orderBy("id"), 40), section("Domains", M.domains(elements).orderBy(F.desc("size"), "name")),
            section("Health", G.health(elements, edges)), "## Components\n\n```mermaid\n" + mermaid(elements, edges, max_edges=60) + "\n```\n", "## Tables\n\n```mermaid\n" + er_diagram(entities, associations) + "\n```",
        ]
    )


def impact_report(affected: DataFrame, hints: DataFrame) -> str:
    return "\n".join(["# Impact\n", section("Summary", G.impact_summary(affected)), section("Affected", affected.orderBy("hops", "id"), 200), section("Suggestions", hints.orderBy("id", "ord"))])


def timeline(changes: DataFrame) -> str:
    return "\n".join(["# Changes\n", section("Summary", R.difference_summary(changes)), section("Most changed", R.headlines(changes).orderBy("change_type", "rank")), section("Details", changes.orderBy("change_type", "id"), 100)])
