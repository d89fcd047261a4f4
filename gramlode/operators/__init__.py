"""Operators on k-mers, filters, bit vectors and trees; all take and return DataFrames."""
