"""Operators of a training-data pipeline over documents, embeddings and web pages.

Each module holds one operator with its general interface; ``queries`` applies
them to the benchmark tables. Nothing outside this subpackage imports it.
"""
