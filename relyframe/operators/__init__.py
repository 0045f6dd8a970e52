"""Operators (DataFrame transformations and fits)."""
