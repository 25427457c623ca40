"""Operators of a training-data pipeline. Nothing outside this folder imports it.

Every operator takes DataFrames and column names, selects the columns it needs
first (so extra or clashing columns are harmless) and returns a DataFrame.
"""
