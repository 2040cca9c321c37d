"""Whole plans: generation, watching, validation, serving, and the registered queries."""
