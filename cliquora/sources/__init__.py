"""Readers: matrices, edge tables, co-authorship text files, generated graphs."""
