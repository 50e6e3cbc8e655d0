"""Streaming queries against static tables."""
