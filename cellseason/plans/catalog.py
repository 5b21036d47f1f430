"""All registered queries."""

from . import catalog_data, catalog_features, catalog_models, catalog_space, catalog_text, flagship  # noqa: F401
from .registry import all_oracles, all_queries

__all__ = ["all_queries", "all_oracles"]
