"""Reusable DataFrame operators: one input table in, one result table out."""
