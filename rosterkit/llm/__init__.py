"""Operators for building training data: mixing, repair, de-duplication, scoring, encoding.

Nothing else in the library imports this subpackage.  ``queries.REGISTRY`` and
``queries.ORACLE`` hold its registered queries and their SQL.
"""
