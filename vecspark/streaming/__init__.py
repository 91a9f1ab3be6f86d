"""Structured Streaming forms of ingest, search and request metrics."""
