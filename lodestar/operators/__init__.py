"""Operators on DataFrames of evidence, prices, facts and predictions."""
