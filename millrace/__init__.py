"""Millrace: columnar analytics as a named layer over Spark DataFrames.

Plans are declared; Catalyst plans them, Tungsten runs them, Parquet stores the
tables. What differs from plain Spark is semantics that a columnar engine of
four types fixes (nulls under NOT, division by zero, null join keys, widened
extremes, empty totals), each available in SQL form as well.
"""
