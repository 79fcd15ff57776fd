"""Operators of a training-data pipeline: tokens, language model, duplicates, mixing, filters, search.

Nothing else in the library imports this subpackage.
"""
