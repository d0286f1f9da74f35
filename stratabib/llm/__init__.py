"""Operators for building training data: entity linkage, clean-up, leakage and mixing.

Nothing outside this subpackage imports it.
"""
