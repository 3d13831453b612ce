"""Incremental versions of ingest and of the daily totals."""
