"""Operators for preparing language-model training data.

The subpackage stands alone: nothing else in the library imports it.
"""
