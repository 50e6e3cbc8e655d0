"""Operators over DataFrames: tags, vectors, graphs, communities, layouts, quality, retrieval, audio."""
