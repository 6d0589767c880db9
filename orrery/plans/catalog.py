"""All registered queries for the library's own operators."""

from __future__ import annotations

from . import graph, model, overlays, questions, relational, sources, streams
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "graph", "model", "overlays", "questions", "relational", "sources", "streams"]
