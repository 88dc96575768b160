"""Structured Streaming ingestion of raw ratings."""
