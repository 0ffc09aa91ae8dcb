"""Registered queries with their oracle SQL."""
