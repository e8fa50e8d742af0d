"""Structured Streaming variants of the windowed and stateful operators."""
