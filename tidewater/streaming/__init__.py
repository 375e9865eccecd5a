"""Structured Streaming over the events table: an extension, the dialect has no streams of its own."""
