"""Structured Streaming versions of incremental aggregates."""
