"""All registered queries."""

from . import analytics_queries, graph_queries, memory_queries, retrieval_queries, streaming_queries, text_queries, work_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
