"""Corpus preparation operators for language-model training data.

Nothing outside this package imports it; it can be removed without affecting
the query and pipeline engine.
"""
