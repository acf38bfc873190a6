"""Structured Streaming twins of the incremental paths."""
