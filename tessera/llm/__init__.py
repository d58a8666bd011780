"""Operators for preparing large text collections for model training.

Nothing outside this folder imports it.
"""
