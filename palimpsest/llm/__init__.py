"""Operators that prepare training text: filters, duplicate removal, formatting and packing.

Nothing outside this subpackage imports it.
"""
