"""Logical plans: dialect rewriting, the statement layer and plan graphs."""
