"""Operators for training-data work on texts; nothing outside this package imports it."""
