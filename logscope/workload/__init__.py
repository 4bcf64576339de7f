"""Registered queries: one or more for every operator."""

from logscope.workload import (  # noqa: F401  (importing registers the queries)
    expressions,
    facets,
    filters,
    indexed,
    live,
    ordering,
    series,
    tables,
)
from logscope.workload.registry import REGISTRY, Entry, Tables

__all__ = ["REGISTRY", "Entry", "Tables"]
