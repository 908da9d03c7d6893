"""Operators for large training-data corpora (self-contained subpackage)."""
