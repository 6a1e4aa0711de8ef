"""Operators for large-scale training-data pipelines.

Each operator is a module of its own with a general interface; ``queries`` holds
the thin contract queries. Nothing else in the library imports this subpackage.
"""
