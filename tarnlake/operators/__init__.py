"""Relational operators of the lakehouse: each takes and returns DataFrames."""
