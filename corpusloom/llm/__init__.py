"""Operators for preparing training data; nothing outside this package imports it."""
