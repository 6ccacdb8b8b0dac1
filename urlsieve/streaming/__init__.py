"""Structured Streaming over the same column functions."""
