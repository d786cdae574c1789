"""Scalar functions and margins as columns."""
