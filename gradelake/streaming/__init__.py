"""Structured Streaming variants of the session and ingest operators."""
