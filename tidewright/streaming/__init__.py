"""Structured Streaming forms of rollups."""
