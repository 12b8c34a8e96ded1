"""Structured Streaming versions of the event pipeline."""
