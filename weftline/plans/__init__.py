"""Intents, expressions, catalog, graphs and their scheduler."""
