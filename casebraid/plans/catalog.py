"""Imports every module that registers queries."""

from . import app_queries, case_queries, cluster_queries, entity_queries, graph_queries, note_queries, text_queries, workspace_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
