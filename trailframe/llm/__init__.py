"""Operators for preparing training text: deduplication, filtering, mixing, tokens.

Nothing else in the package imports this subpackage.
"""
