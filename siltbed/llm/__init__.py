"""Operators for preparing training text: quality, private data, tokens, duplicates, languages, secrets, packing."""
