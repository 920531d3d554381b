"""Incremental variants of operators, for Structured Streaming."""
