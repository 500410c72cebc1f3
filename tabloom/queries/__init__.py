"""Queries over the standard tables, each with the SQL that must give the same rows."""
