"""Incremental results as streams."""
