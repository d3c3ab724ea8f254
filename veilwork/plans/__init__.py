"""All registered queries; importing the modules fills the registry."""

from veilwork.plans import (  # noqa: F401
    compare_queries,
    conditional_queries,
    graph_queries,
    profile_queries,
    scan_queries,
    source_queries,
    stream_queries,
    synth_queries,
    typing_queries,
    validate_queries,
)
from veilwork.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
