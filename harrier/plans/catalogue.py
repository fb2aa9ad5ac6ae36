"""All queries: those of the stages and read models, and those of the pipeline's bookkeeping."""

from harrier.plans import bookkeeping, queries  # noqa: F401  they register their queries
from harrier.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
