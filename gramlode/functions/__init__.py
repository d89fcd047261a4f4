"""Scalar functions: hashing, sequences, rates and number parsing."""
