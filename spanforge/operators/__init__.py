"""Operators on ranges: DataFrame in, DataFrame out, no collect of rows."""
