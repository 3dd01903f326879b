"""Structured Streaming over append-only triples and events."""
