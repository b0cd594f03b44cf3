"""Relational operators of the relevance engine."""
