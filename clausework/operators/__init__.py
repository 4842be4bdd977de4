"""Operators on layouts, chunks, items and rankings; each takes and returns DataFrames."""
