"""Ranges, table builds, guarded SQL and the query registry."""
