"""Structured Streaming forms of the log fold."""
