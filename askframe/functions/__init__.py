"""Column builders: every function maps Columns to a Column."""
