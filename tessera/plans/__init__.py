"""Queries over the given tables, each with its SQL where SQL can express it."""
