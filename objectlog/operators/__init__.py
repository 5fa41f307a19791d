"""Operators over object logs; all lazy."""
