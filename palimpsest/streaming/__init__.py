"""Structured Streaming forms of the write path."""
