"""Incremental forms of the ingest, settling and change-feed operations."""
