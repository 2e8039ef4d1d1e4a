"""Scalar functions over log and run records."""
