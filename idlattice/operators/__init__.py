"""Operators: DataFrame in, DataFrame out; joins, windows and aggregates over many rows."""
