"""Queries and engines built from the operators."""
