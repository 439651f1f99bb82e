"""Incremental rebuilds."""
