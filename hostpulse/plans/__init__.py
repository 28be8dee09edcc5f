"""Registered queries: every operator over data derived from the given tables."""

from hostpulse.plans import detection, fleet, intake, lifecycle, rulebook, upkeep  # noqa: F401
from hostpulse.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
