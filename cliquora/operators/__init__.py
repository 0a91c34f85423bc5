"""Operators on complexes and graphs."""
