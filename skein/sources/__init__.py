"""Readers, parsers and configuration."""
