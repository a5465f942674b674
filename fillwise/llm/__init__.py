"""Operators for large training-data corpora, and their registered queries (``queries.py``).

Nothing else in the package imports this subpackage.
"""
