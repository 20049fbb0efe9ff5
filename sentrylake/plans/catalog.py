"""All registered queries."""

from sentrylake.plans import detections, landing, lookups, records  # noqa: F401
from sentrylake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
