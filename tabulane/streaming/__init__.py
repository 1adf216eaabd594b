"""Structured Streaming jobs over the event table."""
