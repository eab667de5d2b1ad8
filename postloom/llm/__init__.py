"""Operators for large-scale training-data preparation.

Nothing else in the library imports this subpackage.  Every operator reads only
the columns it names, so extra columns (clashing names included) are ignored.
"""
