"""Operators: DataFrame → DataFrame building blocks of the governance queries."""
