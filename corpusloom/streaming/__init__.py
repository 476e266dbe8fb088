"""Resumable ingest as a stream."""
