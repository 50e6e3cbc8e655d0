"""Registered queries: each applies an operator to its tables."""
