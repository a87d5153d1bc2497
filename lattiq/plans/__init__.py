"""Queries of the analytics operators and their SQL."""

from . import design_queries, map_queries, report_queries, score_queries, studies, vector_queries, workflows
from .registry import ORACLES, QUERIES


def all_queries():
    return QUERIES


def all_oracles():
    return ORACLES


__all__ = ["all_oracles", "all_queries", "design_queries", "map_queries", "report_queries", "score_queries", "studies", "vector_queries", "workflows"]
