"""Imports every query module so that the registry is complete."""

from lodegraph.queries import (  # noqa: F401
    q_facts,
    q_functions,
    q_graph,
    q_plans,
    q_quality,
    q_resolve,
    q_sources,
    q_summaries,
)
from lodegraph.queries.registry import CHECKS, QUERIES  # noqa: F401
