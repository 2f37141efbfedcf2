"""Example queries over the driver tables, with the SQL that states each answer."""

from factspan.queries import (  # noqa: F401  (imported to register)
    counts,
    domains,
    history,
    intake,
    jobs,
    joins,
    labels,
    order,
    projection,
    rules,
    series,
)
from factspan.queries.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
