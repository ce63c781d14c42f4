"""Registered queries and their SQL counterparts."""

from graphprep.plans import graph_queries, metric_queries, source_queries, tensor_queries
from graphprep.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "graph_queries", "metric_queries", "source_queries", "tensor_queries"]
