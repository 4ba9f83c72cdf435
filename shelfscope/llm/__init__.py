"""Operators of a training-data pipeline over documents and conversations.

Nothing else in the library imports this subpackage; its queries and their
oracle SQL are in ``queries.py``.
"""
