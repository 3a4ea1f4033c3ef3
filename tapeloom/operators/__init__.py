"""Operators over bar tables; each takes and returns DataFrames."""
