"""Operators for large training corpora: one module per operator, all on DataFrames."""
