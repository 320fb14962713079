"""Structured Streaming forms of the transforms."""
