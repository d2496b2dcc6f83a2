"""Structured Streaming forms of the live operators; any streaming table can be the source."""
