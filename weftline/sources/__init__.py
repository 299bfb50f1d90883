"""Readers of tables and copy-on-write sinks."""
