"""Registered queries over the given tables, and SQL to compare them with."""

from gazetta.queries import aggregates, audits, graph, inference, joins, more, scalars, scans, streams, windows
from gazetta.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "aggregates", "audits", "graph", "inference", "joins", "more", "scalars", "scans", "streams", "windows"]
