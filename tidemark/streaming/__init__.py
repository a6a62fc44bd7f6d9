"""Structured Streaming forms of ingest, windows and limits."""
