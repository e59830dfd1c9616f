"""Operators: functions from DataFrames to DataFrames.

Operators are lazy except where a docstring says that a reduced intermediate is stored in the shared folder.
"""
