"""Incremental ingest of export files with Structured Streaming."""
