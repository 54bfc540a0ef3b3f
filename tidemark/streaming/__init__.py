"""Incremental forms of the rollups, on Structured Streaming."""
