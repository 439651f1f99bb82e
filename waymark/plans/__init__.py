"""Whole flows: building an index, and the named queries."""
