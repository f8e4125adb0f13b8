"""Column functions and small-matrix helpers."""
