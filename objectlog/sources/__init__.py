"""Readers, writers, adapters and mappers."""
