"""Named queries over the driver's tables and the SQL they are held against."""

from skeinmill.plans import ingestion, retrieving, training
from skeinmill.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "ingestion", "retrieving", "training"]
