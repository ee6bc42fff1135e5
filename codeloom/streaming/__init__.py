"""Structured Streaming versions of the batch-boundary operators."""
