"""Scalar and aggregate functions whose results differ from Spark's defaults."""
