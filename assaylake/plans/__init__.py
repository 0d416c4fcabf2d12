"""Registered queries: the operators applied to relational tables, each with its SQL."""
