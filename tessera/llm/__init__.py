"""Operators for large training-text corpora.

Nothing outside this subpackage imports it; the top-level entry module adds its
queries only where the subpackage is present.
"""
