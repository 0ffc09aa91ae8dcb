"""Structured Streaming forms of the checks."""
