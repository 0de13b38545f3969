"""Operators for preparing training data, each on DataFrames with caller-named columns."""
