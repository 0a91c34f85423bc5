"""Complexes and graphs over the TPC-H-like tables, whole tables each."""
