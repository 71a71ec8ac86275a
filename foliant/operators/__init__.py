"""Relational operators on blocks, chunks, points, queries and runs."""
