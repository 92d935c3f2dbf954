"""Operators for preparing language-model training data, on whole tables.

Nothing else in the library imports this subpackage.
"""
