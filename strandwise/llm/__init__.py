"""Operators of large training-data pipelines; nothing outside imports this package."""
