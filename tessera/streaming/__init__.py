"""Structured Streaming roll-ups, de-duplication and alerts."""
