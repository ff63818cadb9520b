"""Incremental bar building."""
