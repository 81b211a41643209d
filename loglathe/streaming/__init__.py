"""Structured Streaming twins of the online miners."""
