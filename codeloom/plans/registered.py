"""Imports every module that registers queries."""

from codeloom.plans import code_queries, file_queries, graph_queries, search_queries  # noqa: F401
