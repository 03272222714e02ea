"""Structured Streaming forms of position events."""
