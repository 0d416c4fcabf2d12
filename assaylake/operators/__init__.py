"""Operators over archives and their flat tables, as functions from DataFrames to DataFrames."""
