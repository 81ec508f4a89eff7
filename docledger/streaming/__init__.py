"""Incremental jobs on Structured Streaming, each with a batch twin."""
