"""Operators for preparing training data at corpus scale.

Nothing outside this folder imports it.  Every operator takes and returns
DataFrames; see each module's docstring for its defined results on nulls,
empty and very long texts, ties, repeated rows and empty tables.
"""
