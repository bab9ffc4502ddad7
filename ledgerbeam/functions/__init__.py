"""Scalar functions, Column in and Column out. Blank values are SQL NULL throughout."""
