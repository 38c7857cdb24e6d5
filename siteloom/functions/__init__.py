"""Scalar functions: exact Python kernels and the column expressions around them."""
