"""All registered queries."""

from __future__ import annotations

from proofgrid.plans import perturbation, preparation, scoring, sources_keys, studies  # noqa: F401
from proofgrid.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
