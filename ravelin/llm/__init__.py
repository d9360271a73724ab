"""Operators on training text. Nothing outside of this package imports it."""
