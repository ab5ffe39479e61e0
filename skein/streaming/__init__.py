"""Streaming pipeline and sinks."""
