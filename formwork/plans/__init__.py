"""The catalogue of queries: each validates a table in some way and has its DuckDB SQL beside it."""

from formwork.plans import structures  # noqa: F401 - registers its queries
from formwork.plans.catalogue import ORACLES, QUERIES, flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
