"""Incremental ingestion of landed pages with Structured Streaming."""
