"""All registered queries."""

from __future__ import annotations

from kymora.plans import queries_contracts, queries_features, queries_posterior, queries_scores, queries_streams, queries_trace, queries_windows  # noqa: F401
from kymora.plans.registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracles():
    return dict(ORACLES)
