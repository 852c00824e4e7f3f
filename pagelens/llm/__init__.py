"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage; ``queries`` holds the
thin registered queries, every other module one operator.
"""
