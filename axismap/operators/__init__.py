"""Operators over maps: each takes and returns DataFrames."""
