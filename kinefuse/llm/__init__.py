"""Operators for preparing text corpora as training data. Nothing else in the library imports this package."""
