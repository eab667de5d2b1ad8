"""Operators of the analytics library."""
