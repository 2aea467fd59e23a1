"""Named queries over the driver tables, with their SQL."""

from scholia.plans import check_queries, extend_queries, extra_queries, more_queries, papers_queries, people_queries, prose_queries, stream_queries, text_queries  # noqa: F401
from scholia.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
