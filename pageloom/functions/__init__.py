"""Scalar expressions on built-in functions: page specifications, names, sizes, progress."""
