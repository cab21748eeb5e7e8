"""Operators for building training data."""
