"""Operators over label maps, pixels and score tables."""
