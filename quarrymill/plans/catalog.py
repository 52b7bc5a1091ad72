"""All queries of the catalogue with the SQL that states the same result."""

from quarrymill.plans import code, curation, evaluation, events, graphs, ranking, records, scalars, statistics  # noqa: F401  (they register)
from quarrymill.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
