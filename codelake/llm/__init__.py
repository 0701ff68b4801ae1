"""Operators of a training-data pipeline, one module per operator.

Nothing outside this subpackage imports it.  Every operator takes a
DataFrame, reads only the columns it names (extra columns, whatever they
are called, are ignored) and returns a DataFrame.  ``queries`` registers
the thin queries over the given tables.
"""
