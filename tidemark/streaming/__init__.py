"""Structured Streaming twins of the batch consumer."""
