"""Operators of a training-data pipeline.

Every module holds one operator with a general interface and, at its end, the
thin ``opN_<name>`` query that derives the digest columns from its output.
Nothing outside this subpackage imports it.
"""
