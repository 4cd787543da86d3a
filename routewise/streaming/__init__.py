"""Structured Streaming: live decision/outcome streams maintaining the features."""
