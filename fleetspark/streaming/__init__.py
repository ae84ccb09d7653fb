"""Structured Streaming forms of the fleet operators."""
