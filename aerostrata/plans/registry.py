"""All registered queries in one place."""

from aerostrata.plans import model_queries  # noqa: F401  (registers its queries)
from aerostrata.plans.catalog import all_queries

__all__ = ["all_queries"]
