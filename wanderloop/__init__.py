"""Trajectory recurrence audits and result-table analytics on PySpark."""

__version__ = "0.1.0"
