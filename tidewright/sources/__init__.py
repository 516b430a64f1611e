"""Readers, cleaning at the edge, and sinks."""
