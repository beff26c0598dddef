"""Structured Streaming over static maps."""
