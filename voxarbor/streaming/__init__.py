"""Structured Streaming variants of the per-tile operators."""
