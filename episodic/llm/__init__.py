"""Operators of a training-data pipeline over raw documents, pages and embeddings.

Nothing else in the library imports this subpackage.
"""
