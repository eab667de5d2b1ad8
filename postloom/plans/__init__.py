"""Queries over the tables of a folder, by subject, each with its SQL where SQL can express it."""
