"""Import this module to register every query."""

from basketry.plans import cart_queries, catalogue_queries, evaluation_queries, feature_queries  # noqa: F401
from basketry.plans.registry import QUERIES, runnable  # noqa: F401
