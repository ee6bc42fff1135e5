"""Readers, sinks and the Parquet store."""
