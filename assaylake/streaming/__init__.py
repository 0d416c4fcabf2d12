"""Structured Streaming over event journals."""
