"""Queries over the driver's tables: one for each operator, and the SQL that each must agree with."""

from . import documents, flows, stores, texts, trees  # noqa: F401  (they add their queries)
from .tables import ORACLE_SQL, QUERIES

FLAGSHIP = "multi_lane_topk"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
