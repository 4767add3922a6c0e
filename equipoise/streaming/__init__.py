"""Structured Streaming forms of the frequency operators."""
