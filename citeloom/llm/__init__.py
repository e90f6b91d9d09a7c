"""Operators for preparing language-model training data, one module each.

Nothing outside this subpackage imports it. ``queries`` registers one query an operator.
"""
