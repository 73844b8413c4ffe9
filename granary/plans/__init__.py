"""Queries by area; importing this package registers them all."""

from . import documents_and_labels, extras, more, relational, scalar, types_and_partitions, wider  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
