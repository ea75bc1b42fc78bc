"""Operators for large training-data pipelines.

Nothing else in the package imports this subpackage. ``queries.QUERIES`` and
``queries.ORACLES`` hold what the entry module registers.
"""
