"""Relational operators of the risk engine; each takes and returns DataFrames."""
