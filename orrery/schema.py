"""Vocabularies: stereotypes with their weights and layers, and the relation types that traversals follow."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Risk weight of an affected element, by stereotype; others weigh 1.
WEIGHTS = {3.0: "Controller Gateway", 2.5: "Configuration", 2.0: "Middleware Service Worker", 1.5: "Repository UI_Component", 1.0: "Component Entity"}
#: Layers from the outside in; a dependency should not point outwards.
LAYERS = {1: "Controller Gateway UI_Component", 2: "Middleware", 3: "Batch_Job Component Service Worker", 4: "Entity Repository Shared_Data", 5: "Configuration"}
#: In which order a newcomer reads the neighbours of an element.
READING = {0: "Batch_Job Controller Gateway UI_Component", 1: "Worker", 2: "Service", 3: "Middleware", 4: "Repository", 5: "Entity", 6: "Shared_Data", 7: "Configuration", 8: "Component"}


def _spread(groups: dict) -> dict[str, float]:
    return {name.replace("_", " "): value for value, names in groups.items() for name in names.split()}


WEIGHT, LAYER, READ_RANK = _spread(WEIGHTS), _spread(LAYERS), _spread(READING)
#: Kinds of elements that are mapped to a table.
MAPPED = "db2_table dclgen jpa po sqlalchemy typeorm".split()
CRITICAL = ["Controller", "Gateway", "Configuration"]
ENTRY = ["Batch Job", "Controller", "Gateway", "UI Component", "Worker"]
TRACE_ENTRY = ["Batch Job", "Controller", "Gateway", "UI Component"]
DATA = ["Entity", "Repository", "Shared Data"]

_CODE = "calls injects routes_to implements"
_DATA = "references accesses_table writes_table reads_dataset writes_dataset"
_HOST = "cics_link cics_xctl executes uses_map copies"
TRACE_RELS = f"{_CODE} {_DATA} {_HOST} cics_start".split()
SLICE_RELS = [*TRACE_RELS, "imports", "composes"]
READING_RELS = f"{_CODE} {_DATA} {_HOST} imports composes performs".split()


def lookup(column: Column | str, values: dict[str, float], default: float) -> Column:
    """A constant by the value of a column."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[F.col(column) if isinstance(column, str) else column], F.lit(default))


def risk(stereotype: Column | str) -> Column:
    """HIGH, MEDIUM or LOW."""
    column = F.col(stereotype) if isinstance(stereotype, str) else stereotype
    weight = lookup(column, WEIGHT, 1.0)
    return F.when(column.isin(CRITICAL) | (weight >= 2.5), "HIGH").when(weight >= 1.5, "MEDIUM").otherwise("LOW")
