"""Structured Streaming: searching queries as they arrive."""
