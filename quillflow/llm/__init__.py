"""Operators of a large-scale training-data pipeline.

Nothing outside this folder imports it.  ``queries.py`` registers one query for
each operator; every module holds one operator with its own general interface.
"""
