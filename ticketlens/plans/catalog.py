"""The full query catalogue: importing this module registers every query."""

from __future__ import annotations

from ticketlens.plans import (  # noqa: F401
    q_drift, q_eval, q_features, q_labels, q_models, q_profile, q_runs, q_scoring, q_sources,
    q_split, q_streams, q_training)
from ticketlens.plans.registry import ORACLE, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return {k: v for k, v in ORACLE.items() if k in QUERIES}
