"""Operators for preparing training data: scoring, deduplication, archives, mixing and filters."""
