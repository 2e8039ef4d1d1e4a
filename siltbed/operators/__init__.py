"""Operators over entries (key, value, tombstone, seq), each from DataFrame to DataFrame."""
