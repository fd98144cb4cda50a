"""Whole dataflows and the catalogue of named queries."""
