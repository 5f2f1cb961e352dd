"""Scalar functions: values and their order, text, encodings."""
