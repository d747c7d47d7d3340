"""Structured Streaming versions of the activity analytics, and the incremental ingest."""
