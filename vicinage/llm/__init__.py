"""Operators for building language-model training data, as Spark jobs.

Nothing else in the library imports this subpackage.
"""
