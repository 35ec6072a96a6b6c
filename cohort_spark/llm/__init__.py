"""Operators for preparing language-model training text, as Spark jobs.

Nothing outside this subpackage imports it.
"""
