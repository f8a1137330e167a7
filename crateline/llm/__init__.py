"""Operators that prepare large collections of records and texts. Nothing outside this package imports it."""
