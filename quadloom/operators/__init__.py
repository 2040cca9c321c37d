"""Operators on features and tiles."""
