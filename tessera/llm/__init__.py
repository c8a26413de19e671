"""Operators for preparing language-model training text at cluster scale.

Nothing outside this subpackage imports it.
"""
