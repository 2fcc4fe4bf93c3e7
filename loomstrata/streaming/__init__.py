"""Accumulating and resumable results as Structured Streaming."""
