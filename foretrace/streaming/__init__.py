"""Structured Streaming versions of ingest, rollup, running history and settlement."""
