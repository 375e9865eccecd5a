"""Relational operators: scans, predicates, joins, aggregates, sorting and set operations."""
