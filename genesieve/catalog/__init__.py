"""The registered queries and the SQL each of them is checked against."""

from importlib import import_module

from .base import REGISTRY, Query

_MODULES = (
    "source_queries", "cleaning_queries", "merging_queries", "feature_queries", "stats_queries",
    "learning_queries",
)


def registry() -> dict[str, Query]:
    for module in _MODULES:
        import_module(f"{__name__}.{module}")
    return REGISTRY
