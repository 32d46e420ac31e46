"""Operators for preparing text for model training; nothing else in the library imports this package."""
