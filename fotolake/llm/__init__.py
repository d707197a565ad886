"""Operators for preparing training text: filters, deduplication, formats and mixing."""
