"""Query-layer operators: every function takes DataFrames and column names, never paths."""
