"""All queries over the driver's tables and their SQL twins, by name."""

from sealmark.plans import audits, claims, coordination, differences, folds, graphs, history, paths, reports, runs, status, stores, texts  # noqa: F401  they register their queries
from sealmark.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
