"""Registered query plans: the named queries and their oracle SQL."""
