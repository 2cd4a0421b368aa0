"""All registered queries and their oracles, by name."""

from __future__ import annotations

from waymark.plans import q_crm, q_datasets, q_diff, q_metrics, q_normalize, q_sources, q_stages  # noqa: F401
from waymark.plans.core import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
