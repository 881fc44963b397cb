"""Incremental refresh: streams folded into tables."""
