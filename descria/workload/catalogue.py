"""All registered queries."""

from __future__ import annotations

from descria.workload import model_queries, prep_queries, structure_queries  # noqa: F401
from descria.workload.registry import QUERIES, TWINS, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def twins() -> dict[str, str]:
    return dict(TWINS)
