"""All queries of the engine and their SQL twins."""

from weftline.plans import function_queries, kernel_queries, native_queries  # noqa: F401 - they register themselves
from weftline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
