"""All queries of the library by name, with SQL for the same results."""

from __future__ import annotations

from vestigraph.plans import answers, documents, evaluation, evidence, governance, graph, ingest, projection, relations, retrieval, rules  # noqa: F401
from vestigraph.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
