"""Relational operators of the variant-calling engine."""
