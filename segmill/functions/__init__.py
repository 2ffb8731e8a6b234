"""Scalar, array and image functions."""
