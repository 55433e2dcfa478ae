"""Every query of the engine, in one place."""

from __future__ import annotations

from spindrift.plans import analysis, curation, pipelines, ranges, serving, text_queries  # noqa: F401  (registers its queries)
from spindrift.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
