"""Operators for preparing training data from documents, pages and vectors.

Nothing else in the library imports this subpackage.
"""
