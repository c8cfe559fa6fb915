"""Incremental forms of ingest and history."""
