"""Scalar functions as column expressions."""
