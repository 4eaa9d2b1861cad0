"""Reusable DataFrame operators: lookups, joins, aggregations, windows and merges."""
