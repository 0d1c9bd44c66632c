"""Queries over the driver's tables, each with its SQL where SQL can express it."""
