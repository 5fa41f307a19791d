"""Operators for training-data corpora: counting, filtering, searching, mixing and deduplicating documents.

Nothing else in the library imports this subpackage.
"""
