"""Vicinity: locally relevant news and public warnings as DataFrames."""
