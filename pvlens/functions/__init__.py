"""Scalar column functions and fixed lexicons."""
