"""Operators on DataFrames; none of them runs a job unless its docstring says so."""
