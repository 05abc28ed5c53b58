"""Every registered query, by topic."""

from flowloom.plans.registered import (  # noqa: F401  (importing registers)
    cleaning,
    columns,
    evaluation,
    features,
    lookup,
    models,
    profile,
    risk,
    rows,
    sampling,
    streaming,
    tables,
    windows,
)
from flowloom.plans.registry import QUERIES

__all__ = ["QUERIES"]
