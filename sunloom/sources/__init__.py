"""Landed files, raw payload tables and table sinks."""
