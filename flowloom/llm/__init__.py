"""Operators for preparing training text at scale, and the queries built on them.

Nothing outside this subpackage imports it.  Each operator module documents
its result for nulls, empty and very long texts, ties, repeated rows, empty
tables and extra columns.
"""
