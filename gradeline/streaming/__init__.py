"""Structured Streaming forms of the batch expressions."""
