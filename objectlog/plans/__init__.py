"""Registered queries, result handles and the tool surface."""
