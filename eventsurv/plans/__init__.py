"""Named queries (``QUERIES``) and their DuckDB oracle text (``ORACLE``)."""

from eventsurv.plans import q_labels, q_features, q_preprocess, q_eval, q_models, q_boost  # noqa: F401  (registration)
from eventsurv.plans.catalog import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
