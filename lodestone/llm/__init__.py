"""Operators for text and code used as training data. Nothing outside this package imports it."""
