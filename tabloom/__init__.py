"""Tabular feature engineering and auto-ML as plain Spark jobs."""
