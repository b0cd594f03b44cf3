"""Readers, derived views, sinks and synthetic data."""
