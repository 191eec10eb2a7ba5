"""Structured Streaming use of the row-preserving operators."""
