"""The registered queries of the capture operators, and their SQL twins."""

from __future__ import annotations

from capture_spark.plans import files, listings, more, paths
from capture_spark.plans.captures import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "files", "listings", "more", "paths"]
