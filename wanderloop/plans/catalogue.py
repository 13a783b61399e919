"""Imports every module that registers queries."""

from wanderloop.plans import geometry, release, sequences, sweeps, tables, walk_tests  # noqa: F401
from wanderloop.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
