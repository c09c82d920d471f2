"""Relational and text operators; each takes and returns DataFrames."""
