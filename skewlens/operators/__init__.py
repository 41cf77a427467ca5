"""Table-to-table operators. Every function takes DataFrames and returns DataFrames."""
