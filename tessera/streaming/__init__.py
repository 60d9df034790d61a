"""Incremental work by Structured Streaming."""
