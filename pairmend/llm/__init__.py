"""Operators for preparing training data: near-duplicates, fingerprints, quality, mixing, tokens.

Nothing else in the library imports this package.
"""
