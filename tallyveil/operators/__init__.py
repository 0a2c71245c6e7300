"""DataFrame operators. Each takes and returns DataFrames.

Operators that rank, iterate or fit checkpoint intermediate tables and therefore run jobs
when they are called; all others stay lazy.
"""
