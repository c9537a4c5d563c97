"""Registered queries: derived relations, the queries themselves and their SQL."""
