"""Relational operators over coded text: each takes DataFrames and returns DataFrames."""
