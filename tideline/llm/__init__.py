"""Operators for preparing training data. Nothing outside this package imports it."""
