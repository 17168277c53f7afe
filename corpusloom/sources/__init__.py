"""Readers, validated imports, landing-zone parsers and sinks."""
