"""Operators that prepare large text corpora for model training.

Nothing else in the package imports this folder; it can be removed whole.
"""
