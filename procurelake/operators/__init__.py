"""Relational operators: normalising, deduplication, versions, extraction, review, search."""
