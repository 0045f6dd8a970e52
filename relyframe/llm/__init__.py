"""Operators for large training-text tables (PII, duplicates, tokens, quality, chat, ...).

Nothing else in the package imports this subpackage.
"""
