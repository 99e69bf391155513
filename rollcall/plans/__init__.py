"""Registered queries, their DuckDB oracle SQL and distributed row positions."""
