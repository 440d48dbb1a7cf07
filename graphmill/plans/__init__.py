"""The library's named queries.  Importing this package registers them."""

from graphmill.plans import aggregate_queries, build_queries, fusion_queries, graph_queries, retrieval_queries, stream_queries, text_queries, window_queries  # noqa: F401
from graphmill.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
