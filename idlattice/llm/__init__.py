"""Operators of a training-data pipeline over corpora of documents, pages and vectors.

Nothing outside this subpackage imports it; ``queries`` holds its registry.
"""
