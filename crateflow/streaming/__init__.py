"""Structured Streaming ingest of landed payloads."""
