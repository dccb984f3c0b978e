"""Test inputs derived from the given tables, and the query catalogue with its SQL."""
