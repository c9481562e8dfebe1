"""Operators for text and vector training-data preparation. Nothing outside this package imports it."""
