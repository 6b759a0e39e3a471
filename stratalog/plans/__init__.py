"""Importing this package registers every query of the engine."""

from stratalog.plans import analytics, answers, details, folders, knowledge, outlines, pipelines, queueing, scalars, scans, writes  # noqa: F401
from stratalog.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
