"""Column builders for grouped reductions and transforms."""
