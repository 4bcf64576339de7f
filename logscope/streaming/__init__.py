"""Structured Streaming forms of the panels that refresh."""
