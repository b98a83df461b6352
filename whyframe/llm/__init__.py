"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; the registry of queries reads it
only when it is present.
"""
