"""Estimators on matrix sets: fit(df) learns a small numpy model, transform / predict add columns to a DataFrame.

Columns are named by arguments: id, cov (matrix), y (label or target), w (weight).
"""
