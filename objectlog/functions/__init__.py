"""Scalar functions as Column expressions, and text renderers."""
