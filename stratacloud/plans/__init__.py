"""Registered queries: bindings of the operators to the given tables, with their SQL checks."""
