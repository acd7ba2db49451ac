"""Streams: ingestion, sessions and event windows."""
