"""Composed jobs, the registered queries and their DuckDB oracles."""
