"""All registered queries and their SQL oracles."""

from __future__ import annotations

from . import q_clean, q_eda, q_explain, q_features, q_io, q_metrics, q_models, q_profile, q_runs  # noqa: F401  (registration side effects)
from .registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
