"""Operators of the tick analytics library."""
