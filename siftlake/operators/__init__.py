"""Predicates, the query builder, string-typed queries and the line language."""
