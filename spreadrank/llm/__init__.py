"""Operators of a pipeline that prepares training text. Nothing else in the package imports them."""
