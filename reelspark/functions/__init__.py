"""Scalar, array and text expressions."""
