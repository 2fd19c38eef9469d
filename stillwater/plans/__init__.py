from . import compare_queries, function_queries, geometry_queries, presentation_queries, response_queries, session_queries, temporal_queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
